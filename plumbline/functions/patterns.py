"""Regular expressions of a linear-time dialect, in the words of java.util.regex.

The dialect has no look-around and no references, so every pattern is a
regular language and only whether it matches counts.  Greed therefore doesn't
matter, and names of groups are left out.
"""

from __future__ import annotations

import string

from ..errors import Invalid

#: Dot, line ends and anchors know line feeds only; classes and cases are those of Unicode.
PREFIX = "(?dU)"
_ASCII = {
    "alnum": "0-9A-Za-z",
    "alpha": "A-Za-z",
    "ascii": "\\x00-\\x7F",
    "blank": "\\t ",
    "cntrl": "\\x00-\\x1F\\x7F",
    "digit": "0-9",
    "graph": "!-~",
    "lower": "a-z",
    "print": " -~",
    "punct": "!-/:-@\\[-`{-~",
    "space": "\\t\\n\\x0B\\f\\r ",
    "upper": "A-Z",
    "word": "0-9A-Za-z_",
    "xdigit": "0-9A-Fa-f",
}
_CATEGORIES = {
    "letter": "L", "lowercaseletter": "Ll", "uppercaseletter": "Lu", "titlecaseletter": "Lt", "modifierletter": "Lm", "otherletter": "Lo",
    "mark": "M", "number": "N", "decimalnumber": "Nd", "punctuation": "P", "symbol": "S", "separator": "Z", "other": "C",
}


class _Translator:
    def __init__(self, pattern: str):
        self.p, self.at = pattern, 0

    def fail(self, why: str) -> Invalid:
        return Invalid(f"regular expression: {why} at character {self.at}")

    def peek(self, n: int = 1) -> str:
        return self.p[self.at : self.at + n]

    def take(self, n: int = 1) -> str:
        if self.at + n > len(self.p):
            raise self.fail("it ends too soon")
        self.at += n
        return self.p[self.at - n : self.at]

    def until(self, end: str) -> str:
        stop = self.p.find(end, self.at)
        if stop < 0:
            raise self.fail(f"there is no {end!r}")
        found = self.p[self.at : stop]
        self.at = stop + len(end)
        return found

    def alternatives(self, multi: bool, verbose: bool, depth: int) -> str:
        """Up to the end or the closing bracket; flags set inside hold up to there."""
        if depth > 200:
            raise self.fail("groups are nested too deep")
        out: list[str] = []
        repeatable, repeated = False, False  # what stands last
        while self.at < len(self.p):
            c = self.peek()
            if c == ")":
                break
            self.at += 1
            if verbose and c.isspace():
                continue
            if verbose and c == "#":
                stop = self.p.find("\n", self.at)
                self.at = len(self.p) if stop < 0 else stop
                continue
            if c in "*+?":
                if not repeatable:
                    raise self.fail("nothing to repeat")
                self.repeat(out, c, repeated)
                repeated = True
                continue
            if c == "{":
                if not repeatable:
                    raise self.fail("nothing to repeat")
                low, comma, high = (x.strip() for x in self.until("}").partition(","))
                if not low.isdecimal() or (high and not high.isdecimal()) or (high and int(high) < int(low)):
                    raise self.fail("a bad repetition")
                self.repeat(out, "{" + low + comma + high + "}", repeated)
                repeated = True
                continue
            repeated, repeatable = False, True
            if c == "|":
                out.append("|")
                repeatable = False
            elif c == "(":
                group, multi, verbose = self.group(multi, verbose, depth)
                out.append(group)
                repeatable = bool(group)
            elif c == "[":
                out.append(self.bracket(verbose))
            elif c == "\\":
                out.append(self.escape(False))
            elif c == "$":
                out.append("(?m:$)" if multi else "\\z")
            elif c == "^":
                out.append("(?m:^)" if multi else "\\A")
            elif c in "]}#&~- " or c.isspace():
                out.append(f"\\{c}" if c in "]}#&~-" else f"\\x{{{ord(c):x}}}")
            else:
                out.append(c)
        return "".join(out)

    def repeat(self, out: list[str], sign: str, again: bool) -> None:
        if self.peek() == "?":  # lazy: the same words match
            self.at += 1
        # a repetition of a repetition is a group's, for two signs in a row mean another thing there
        out[-1] = f"(?:{out[-1]}){sign}" if again else out[-1] + sign

    def group(self, multi: bool, verbose: bool, depth: int) -> tuple[str, bool, bool]:
        """A group, or flags for what follows; and whether lines and comments are known after it."""
        head, inner, loose = "(?:", multi, verbose
        if self.peek() == "?":
            self.at += 1
            if self.peek(2) == "P<" or self.peek() == "<" and self.peek(2) not in ("<=", "<!"):
                self.take(2 if self.peek() == "P" else 1)
                name = self.until(">")
                if not name or not (name[0].isalpha() or name[0] == "_") or not all(x.isalnum() or x in "_.[]" for x in name):
                    raise self.fail("a bad name of a group")
            else:
                flags = ""
                while self.peek() not in (":", ")", ""):
                    flags += self.take()
                end = self.take()
                on, _, off = flags.partition("-")
                if set(on + off) - set("imsxuUR") or flags.endswith("-") or (end == ")" and not flags):
                    raise self.fail("look-around, or an unknown kind of group")
                inner, loose = (inner or "m" in on) and "m" not in off, (loose or "x" in on) and "x" not in off
                keep = lambda s: "".join({"i": "i", "s": "s", "u": "U"}.get(x, "") for x in s)
                kept = keep(on) + ("-" + keep(off) if keep(off) else "")
                if end == ")":
                    return f"(?{kept})" if kept else "", inner, loose
                head = f"(?{kept}:"
        body = self.alternatives(inner, loose, depth + 1)
        if self.peek() != ")":
            raise self.fail("a group isn't closed")
        self.at += 1
        return f"{head}{body})", multi, verbose

    def bracket(self, verbose: bool) -> str:
        """A class in square brackets; its opening bracket has been read."""
        negated = self.peek() == "^"
        self.at += negated
        parts, now, first = [], "", True
        while True:
            c = self.take()
            if c == "]" and not first:
                break
            if verbose and c.isspace():
                continue
            if c == "[":
                if self.peek() == ":" and (stop := self.p.find(":]", self.at)) > 0 and self.p[self.at + 1 : stop].lstrip("^") in _ASCII:
                    name = self.p[self.at + 1 : stop]
                    self.at = stop + 2
                    now += f"[^{_ASCII[name[1:]]}]" if name[0] == "^" else f"[{_ASCII[name]}]"
                else:
                    now += self.bracket(verbose)
            elif c == "\\":
                now += self.escape(True)
            elif c + self.peek() in ("&&", "--") and not first and now:
                self.at += 1
                parts.append(now)
                parts.append(c)
                now = ""
            elif c + self.peek() == "~~" and not first and now:
                raise self.fail("a symmetric difference of classes isn't supported")
            elif c == "-" and now and self.peek() not in ("]", "-") and not first:
                now += "-"
            elif c in "]-&^~#" or c.isspace():
                now += f"\\{c}" if not c.isspace() else f"\\x{{{ord(c):x}}}"
            else:
                now += c
            first = False
        parts.append(now)
        out = f"[{parts[0]}]"
        for sign, other in zip(parts[1::2], parts[2::2]):
            if not other:
                raise self.fail("a class lacks an operand")
            out = f"[{out}&&[{other}]]" if sign == "&" else f"[{out}&&[^[{other}]]]"
        return f"[^{out}]" if negated else out

    def escape(self, inside: bool) -> str:
        c = self.take()
        if c in "dDsSwW" or c in "nrtfa":
            return f"\\{c}"
        if c == "v":
            return "\\x0B"
        if c in "pP":
            name = self.until("}") if self.peek() == "{" and self.take() else self.take()
            if name.startswith("^"):
                c, name = "P" if c == "p" else "p", name[1:]
            if name.lower() in ("any", "ascii", "assigned"):
                own = {"any": "\\x{0}-\\x{10FFFF}", "ascii": "\\x00-\\x7F", "assigned": "\\P{Cn}"}[name.lower()]
                return f"[{own}]" if c == "p" else f"[^{own}]"
            return f"\\{c}{{{self.property(name)}}}"
        if c in "xuU":
            if self.peek() == "{":
                self.at += 1
                digits = self.until("}")
            else:
                digits = self.take({"x": 2, "u": 4, "U": 8}[c])
            if not digits or set(digits) - set(string.hexdigits) or int(digits, 16) > 0x10FFFF:
                raise self.fail("a bad code of a character")
            return f"\\x{{{digits}}}"
        if not inside:
            if c == "b" and self.peek() == "{":
                self.at += 1
                side = {"start": "(?<!\\w)(?=\\w)", "end": "(?<=\\w)(?!\\w)", "start-half": "(?<!\\w)", "end-half": "(?!\\w)"}.get(self.until("}"))
                if side is None:
                    raise self.fail("an unknown kind of boundary")
                return side
            if c in "bBAz":
                return f"\\{c}"
            if c in "<>":
                return "(?<!\\w)(?=\\w)" if c == "<" else "(?<=\\w)(?!\\w)"
        if c in string.punctuation:
            return f"\\{c}"
        raise self.fail(f"references, and what \\{c} might be, aren't supported")

    def property(self, name: str) -> str:
        key, sign, value = name.replace(":", "=").partition("=")
        plain = "".join(x for x in (value or key).lower() if x not in " _-")
        if not plain.isalnum():
            raise self.fail("a bad name of a class")
        if plain in _CATEGORIES:
            return _CATEGORIES[plain]
        if sign and key.lower() not in ("gc", "generalcategory", "general_category"):
            return f"script={value}"
        return (value or key) if len(plain) <= 2 else f"Is{value or key}"


def java_pattern(pattern: str) -> str:
    """pattern for rlike; Invalid says what is wrong with it."""
    if not isinstance(pattern, str):
        raise Invalid("a regular expression is a text")
    t = _Translator(pattern)
    body = t.alternatives(False, False, 0)
    if t.at < len(pattern):
        raise t.fail("a bracket too many")
    return PREFIX + body


def check_pattern(pattern: str) -> str:
    """The same, read by Java as well if there is a session."""
    from pyspark import SparkContext

    translated = java_pattern(pattern)
    context = SparkContext._active_spark_context
    if context is not None:
        try:
            context._jvm.java.util.regex.Pattern.compile(translated)
        except Exception as error:
            raise Invalid(f"regular expression: {getattr(error, 'java_exception', error)}") from None
    return translated
