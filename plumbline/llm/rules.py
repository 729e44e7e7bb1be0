"""Operator 7: quality rules that compare a document with the references of its language."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textops
from .common import Scratch, settled

CLASSES = ("lower", "upper", "other_letter", "mark", "digit", "space", "line_end", "punctuation", "symbol", "other")
COMMON = 40
LANGUAGES = 1000  # whose references are broadcast, of about 100 numbers each; rows of others are joined to theirs
CHAR_LIMIT = 0.25
WORD_LIMIT = 0.42
MIN_CHARS = 300
MIN_WORDS = 60
_kinds: np.ndarray | None = None


def char_class(c: str) -> int:
    """Index in CLASSES."""
    if c in "\n\r  ":
        return 6
    kind = unicodedata.category(c)
    if c.isspace() or kind == "Zs":
        return 5
    return {"Ll": 0, "Lu": 1, "Lt": 1}.get(kind, {"L": 2, "M": 3, "N": 4, "P": 7, "S": 8}.get(kind[0], 9))


def _table() -> np.ndarray:
    """char_class of the characters below U+10000; the last entry stands for all others, mostly symbols."""
    global _kinds
    if _kinds is None:
        _kinds = np.array([char_class(chr(i)) for i in range(0xFFFF)] + [8], np.uint8)
    return _kinds


def class_counts(texts: list[str]) -> np.ndarray:
    """Characters of each class in each text."""
    cp, base = textops.codepoints(texts)
    kind = _table()[np.minimum(cp, np.uint32(0xFFFF))]
    owner = np.repeat(np.arange(len(texts)), np.diff(base))
    counts = np.bincount(owner * len(CLASSES) + kind, minlength=len(texts) * len(CLASSES)).reshape(len(texts), -1)
    counts[:, 6] -= 1  # the line feed that ends each text in its block
    return counts


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence in bits, 0 to 1, of each row of counts p against the shares in q's row."""
    p = p / np.maximum(p.sum(axis=1, keepdims=True), 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.clip((left + right) / 2, 0, 1)


def _counted(docs: DataFrame) -> DataFrame:
    """(lang, kind, key, n): characters by class (kind 0) and words by hash (kind 1), over all texts."""

    def run(batches):
        for batch in batches:
            langs, texts = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_pylist()
            names, which = np.unique(langs, return_inverse=True)
            for a, b in textops.blocks(texts, 1 << 22):
                own = which[a:b]
                order = np.argsort(own, kind="stable")
                part, own = [texts[a + i] for i in order.tolist()], own[order]
                chars = class_counts(part)
                w = textops.words(part)
                for k in np.unique(own).tolist():
                    lo, hi = np.searchsorted(own, [k, k + 1]).tolist()
                    keys, n = np.unique(w.hash[w.first[lo] : w.first[hi]], return_counts=True)
                    total = chars[lo:hi].sum(axis=0)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([names[k]] * (len(keys) + len(total)), pa.string()),
                            pa.array(np.repeat(np.array([0, 1], np.int32), [len(total), len(keys)])),
                            pa.array(np.concatenate([np.arange(len(total)), keys.view(np.int64)])),
                            pa.array(np.concatenate([total, n])),
                        ],
                        names=["lang", "kind", "key", "n"],
                    )

    return docs.mapInArrow(settled(run), "lang string, kind int, key long, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))


def references(docs: DataFrame, scratch: Scratch, common: int = COMMON) -> DataFrame:
    """(lang, size, chars, words, total): for each language its characters, those of each class, its commonest words as (key, n), and all its words.

    Counts are over all texts, made once.  Words that are equally common rank
    by their hash.  The commonest are found in each partition first, so that
    no task sorts a language's vocabulary; rows are of bounded size.
    """
    text = docs.where("text IS NOT NULL").select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), "text")
    counted = scratch.save(_counted(text), "counts")
    entries = lambda: F.sort_array(F.collect_list(F.struct("key", "n")))
    chars = counted.where("kind = 0").groupBy("lang").agg(F.sum("n").alias("size"), F.transform(entries(), lambda x: x["n"]).alias("chars"))
    words = counted.where("kind = 1").drop("kind")
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "key")
    top = words.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= common).groupBy("lang").agg(entries().alias("words"))
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    return scratch.save(chars.join(top, "lang", "left").join(totals, "lang", "left"), "references")


def _reference(chars: list[int], words: list, total: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shares of character classes, hashes of the commonest words in rising order, shares of those and of all other words."""
    keys, n = np.array([k for k, _ in words or []], np.int64).view(np.uint64), np.array([m for _, m in words or []], float)
    place = np.argsort(keys)
    shares = np.append(n[place], (total or 0) - n.sum())
    whole = np.array(chars, float)
    return whole / max(whole.sum(), 1), keys[place], shares / max(shares.sum(), 1)


_NONE = (np.zeros(len(CLASSES)), np.zeros(0, np.uint64), np.ones(1))


def distances(langs: list[str], texts: list[str], refs: dict, char_limit: float, word_limit: float, min_chars: int, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distance of characters and of words of each text (NaN if it has none), and whether it is rejected."""
    out, reject = np.full((len(texts), 2), np.nan), np.zeros(len(texts), bool)
    for a, b in textops.blocks(texts):
        chars, w = class_counts(texts[a:b]), textops.words(texts[a:b])
        n_words = np.diff(w.first)
        own = np.array([refs.get(k, _NONE)[0] for k in langs[a:b]])
        out[a:b, 0] = np.where(chars.sum(axis=1) > 0, np.sqrt(divergence(chars, own)), np.nan)
        for k in set(langs[a:b]):
            _, keys, shares = refs.get(k, _NONE)
            rows = np.array([i for i in range(b - a) if langs[a + i] == k])
            of = np.repeat(rows, n_words[rows])
            if not len(of) or not len(keys):
                continue
            mine = np.zeros(len(n_words), bool)
            mine[rows] = True
            hashes = w.hash[np.repeat(mine, n_words)]
            at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
            column = np.where(keys[at] == hashes, at, len(keys))
            counts = np.bincount(np.searchsorted(rows, of) * (len(keys) + 1) + column, minlength=len(rows) * (len(keys) + 1)).reshape(len(rows), -1)
            out[a + rows, 1] = np.where(n_words[rows] > 0, np.sqrt(divergence(counts, shares[None, :])), np.nan)
        reject[a:b] = (out[a:b, 0] > char_limit) & (chars.sum(axis=1) >= min_chars) | (out[a:b, 1] > word_limit) & (n_words >= min_words)
    return out, reject


def judge(docs: DataFrame, scratch: Scratch, common: int = COMMON, languages: int = LANGUAGES, char_limit: float = CHAR_LIMIT, word_limit: float = WORD_LIMIT, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, lang, char_distance, word_distance, keep) for each row of docs.

    A distance is the Jensen-Shannon distance (the root of the divergence in
    bits, 0 to 1) of the document's histogram from its language's: of
    characters by class, and of words, with one bin for each of the
    language's ``common`` commonest words (equally common ones in the order of
    their hash) and one for all others.  References are counted over all of
    docs.  A row is rejected if a distance is over its limit and the text has
    at least ``min_chars`` characters (or ``min_words`` words, for the word
    distance); shorter texts have distances but are kept.

    The references of the ``languages`` languages of most characters are
    broadcast; rows of all others, if there are more, are joined to theirs.

    A null or empty text has null distances and is kept, so are texts without
    words in word_distance.  Null languages, and empty names, are one
    language.  Texts of any length are read whole.  Repeated rows each have a
    result; a null doc_id stays null.  Other columns are ignored.  No
    documents, no rows.
    """
    limits = (char_limit, word_limit, min_chars, min_words)
    refs = references(docs, scratch, common)
    known = refs.orderBy(F.desc("size"), "lang").limit(languages)
    rows = known.collect()  # at most ``languages``, of bounded size
    shared = docs.sparkSession.sparkContext.broadcast({r["lang"]: _reference(r["chars"], r["words"], r["total"]) for r in rows})

    @F.pandas_udf("char_distance double, word_distance double, reject boolean")
    def compare(lang: pd.Series, text: pd.Series) -> pd.DataFrame:
        texts, langs = [t if t is not None else "" for t in text], [x if x is not None else "" for x in lang]
        out, reject = distances(langs, texts, shared.value, *limits)
        return pd.DataFrame({"char_distance": out[:, 0], "word_distance": out[:, 1], "reject": reject})

    null = F.lit(None).cast("double")

    def result(judged):
        return judged.select("doc_id", "lang", F.nanvl("char_distance", null).alias("char_distance"), F.nanvl("word_distance", null).alias("word_distance"), (~F.col("reject")).alias("keep"))

    own = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    if len(rows) < languages:
        return result(own.withColumn("r", compare("lang", "text")).select("doc_id", "lang", "r.*"))
    names = docs.sparkSession.createDataFrame([(r["lang"],) for r in rows], "name string")
    found = own.withColumn("named", F.coalesce("lang", F.lit(""))).join(F.broadcast(names), F.col("named") == F.col("name"), "left")
    first = found.where("name IS NOT NULL").withColumn("r", compare("lang", "text")).select("doc_id", "lang", "r.*")
    others = refs.join(F.broadcast(names), F.col("lang") == F.col("name"), "left_anti").select(F.col("lang").alias("named"), "chars", "words", "total")
    # a language without any text has no reference, and needs none
    rest = found.where("name IS NULL").join(others, "named", "left").select("doc_id", "lang", "named", "text", "chars", "words", "total")

    def alone(batches):
        for batch in batches:
            langs, texts = batch.column(2).to_pylist(), [t or "" for t in batch.column(3).to_pylist()]
            own = {}
            for i, k in enumerate(langs):
                if k not in own and batch.column(4)[i].is_valid:
                    own[k] = _reference(batch.column(4)[i].as_py(), [(x["key"], x["n"]) for x in batch.column(5)[i].as_py() or []], batch.column(6)[i].as_py())
            out, reject = distances(langs, texts, own, *limits)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out[:, 0]), pa.array(out[:, 1]), pa.array(reject)], names=["doc_id", "lang", "char_distance", "word_distance", "reject"])

    kind = dict(docs.dtypes)["doc_id"]
    return result(first).union(result(rest.mapInArrow(alone, f"doc_id {kind}, lang string, char_distance double, word_distance double, reject boolean")))
