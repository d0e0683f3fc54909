"""Text normalisation, segmentation and tokenisation as Column expressions."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import NormalizationConfig

#: White space as Python's ``str.split`` has it, as a Java character class.
WS = r"\s\x1c-\x1f\x85   -     　"
LINE_BREAK = r"\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85  ]"
SENTENCE_BREAK = rf"(?<=[.!?])[{WS}]+(?=[A-Z0-9])"
TOKEN = r"(?iu)[0-9a-z]+(?:[._:/\\@+\-'][0-9a-z]+)*"

_FOLDS = {
    "'": "‘’‛′",
    '"': "“”„«»",
    "-": "‐‑‒–—−",
    " ": "…",
    ".": "·．。",
    "/": "⁄∕／",
    "@": "＠",
    "+": "＋",
    "_": "＿",
}
FOLD_FROM = "".join(_FOLDS.values())
FOLD_TO = "".join(k * len(v) for k, v in _FOLDS.items())
#: Bytes of text that a worker cuts at once, so that its memory doesn't grow with its batches.
SLICE = 1 << 20


@functools.cache
def _nfkc():
    # Arrow's own utf8_normalize leaves composed letters apart, and unicodedata returns normal texts as they are.
    def run(a: pa.Array) -> pa.Array:
        return pa.array([s if s is None or s.isascii() else unicodedata.normalize("NFKC", s) for s in a.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")


@functools.cache
def _plain_letters():
    def strip(s: str | None) -> str | None:
        return s if s is None or s.isascii() else "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))

    def run(a: pa.Array) -> pa.Array:
        return pa.array([strip(s) for s in a.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")


def nfkc(c: Column) -> Column:
    return _nfkc()(c)


def strip_accents(c: Column) -> Column:
    return _plain_letters()(c)


def fold_punctuation(c: Column) -> Column:
    return F.translate(c, FOLD_FROM, FOLD_TO)


def collapse_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, rf"[{WS}]+", " "))


def strip_space(c: Column) -> Column:
    return F.regexp_replace(c, rf"^[{WS}]+|[{WS}]+$", "")


def base_normal(c: Column, cfg: NormalizationConfig) -> Column:
    """NFKC, punctuation folds, lower case, accents, white space; in this order."""
    if cfg.unicode_nfkc:
        c = nfkc(c)
    c = fold_punctuation(c)
    if cfg.lowercase:
        c = F.lower(c)
    if cfg.strip_accents:
        c = strip_accents(c)
    return collapse_space(c)


def tokens(c: Column, cfg: NormalizationConfig) -> Column:
    """The array of tokens of a text."""
    base = base_normal(c, cfg)
    if not cfg.strip_punctuation:
        return F.filter(F.split(base, " "), lambda t: t != "")
    return F.regexp_extract_all(base, F.lit(TOKEN), F.lit(0))


def normalize_text(c: Column, cfg: NormalizationConfig) -> Column:
    """Tokens joined by spaces; the base form where there are none."""
    joined = F.array_join(tokens(c, cfg), " ")
    return F.when(joined != "", joined).otherwise(base_normal(c, cfg))


def lines(c: Column) -> Column:
    """Non-empty stripped lines."""
    return F.filter(F.transform(F.split(c, LINE_BREAK), strip_space), lambda s: s != "")


def raw_segments(c: Column, cfg: NormalizationConfig) -> Column:
    """Lines, cut into sentences, in their original spelling."""
    out = lines(c)
    if cfg.pysbd_language is not None:
        return _pysbd(cfg.pysbd_language)(out)
    if cfg.split_sentences:
        out = F.flatten(F.transform(out, lambda s: F.split(s, SENTENCE_BREAK)))
        out = F.filter(F.transform(out, strip_space), lambda s: s != "")
    return out


@functools.cache
def _pysbd(language: str):
    def run(a: pa.Array) -> pa.Array:
        import pysbd

        cut = pysbd.Segmenter(language=language, clean=True)
        rows = [None if v is None else [t for s in v for x in cut.segment(s) if (t := x.strip())] for v in a.to_pylist()]
        return pa.array(rows, pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")


class Tokens(NamedTuple):
    """Tokens of some texts, one after another: the row of each segment's text, the segment's number in it, and where its tokens begin."""

    row: np.ndarray
    seg_no: np.ndarray
    offsets: np.ndarray
    values: pa.Array


def slices(b: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """``b`` in pieces of about ``SLICE`` bytes of text; one longer text is a piece of its own."""
    total = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    edges = [0, *(np.flatnonzero(np.diff(total // SLICE)) + 1).tolist(), b.num_rows]
    for i, j in zip(edges, edges[1:]):
        if j > i:
            yield b.slice(i, j - i)


def _plain(cfg: NormalizationConfig) -> Callable[[str], list[str]]:
    """``tokens`` for a plain string, with line feeds as items of their own."""
    fold = str.maketrans(FOLD_FROM, FOLD_TO)
    letter = "[0-9A-Za-z\u0130\u0131\u017f\u212a]+"  # what Java's (?iu)[0-9a-z] takes
    find = re.compile(rf"\n|{letter}(?:[._:/\\@+\-']{letter})*").findall

    def run(s: str) -> list[str]:
        plain = s.isascii()
        if not plain:
            s = (unicodedata.normalize("NFKC", s) if cfg.unicode_nfkc else s).translate(fold)
        if cfg.lowercase:
            s = s.lower()
        if cfg.strip_accents and not plain:
            s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
        return find(s)

    return run


def text_tokens(cfg: NormalizationConfig, cut: bool) -> Callable[[pa.Array], Tokens]:
    """A function from an array of texts to their tokens; ``cut``: by segments, as ``raw_segments`` has them, else each text is one.

    It does what the Column expressions do for texts whose signs are stripped, in one pass over plain strings.
    """
    find, sentence = _plain(cfg), re.compile(r"([.!?])\s+(?=[A-Z0-9])")

    def run(texts: pa.Array) -> Tokens:
        flat: list[str] = []
        count = np.zeros(len(texts), np.int64)
        for i, s in enumerate(texts.to_pylist()):
            if not s:
                continue
            if cut:
                s = "\n".join(x for line in s.splitlines() if (x := line.strip()))
                if cfg.split_sentences:
                    s = sentence.sub(r"\1\n", s)
                if not s:
                    continue
            elif "\n" in s:
                s = s.replace("\n", " ")
            count[i] = s.count("\n") + 1
            flat += find(s)
            flat.append("\n")
        values = pa.array(flat, pa.string())
        end = pc.equal(values, "\n").to_numpy(zero_copy_only=False)
        at = np.flatnonzero(end)
        offsets = np.concatenate([[0], at - np.arange(len(at))]).astype(np.int32)
        row = np.repeat(np.arange(len(count)), count)
        first = np.cumsum(count) - count
        return Tokens(row, (np.arange(len(row)) - first[row]).astype(np.int32), offsets, values.filter(pa.array(~end)))

    return run


def plain(cfg: NormalizationConfig) -> bool:
    """Whether ``text_tokens`` can cut texts under these settings."""
    return cfg.strip_punctuation and cfg.pysbd_language is None


def segments(docs: DataFrame, cfg: NormalizationConfig) -> DataFrame:
    """(doc_ord, seg_no, tok): the non-empty training segments of ``docs`` (doc_ord, text)."""
    some = docs.where("text IS NOT NULL AND text <> ''")
    if not plain(cfg):
        cut = some.select("doc_ord", F.posexplode(raw_segments(F.col("text"), cfg)).alias("seg_no", "raw"))
        return cut.select("doc_ord", "seg_no", tokens(F.col("raw"), cfg).alias("tok")).where(F.size("tok") > 0)

    def run(batches):
        cut = text_tokens(cfg, True)
        for b in batches:
            for x in slices(b):
                t = cut(x.column("text"))
                out = pa.RecordBatch.from_arrays([x.column("doc_ord").take(pa.array(t.row)), pa.array(t.seg_no), pa.ListArray.from_arrays(pa.array(t.offsets), t.values)], names=["doc_ord", "seg_no", "tok"])
                yield out.filter(pa.array(np.diff(t.offsets) > 0))

    return some.select(F.col("doc_ord").cast("long"), "text").mapInArrow(run, "doc_ord long, seg_no int, tok array<string>")


# Small forms used in serving.


def redundancy_form(c: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def dedupe_form(c: Column) -> Column:
    return collapse_space(F.lower(c))


def noise(token: Column) -> Column:
    """10 for a slash or dot, and 8 for a digit, in a token."""
    return F.when(token.rlike(r"[/.]"), 10.0).otherwise(0.0) + F.when(token.rlike(r"\p{Nd}"), 8.0).otherwise(0.0)


def weak_boundary(token: Column) -> Column:
    return token.rlike(r"^\p{L}{1,2}$")


def quantise(v: Column) -> Column:
    """Units of 1/1024, rounded half to even."""
    return F.rint(v * 1024.0).cast("int")


def clamp16(v: Column) -> Column:
    return F.greatest(F.lit(-32768), F.least(F.lit(32767), v))


def partial_token(t: Column) -> Column:
    """About 60 % of a word, as a user would have typed it."""
    n = F.length(t)
    return F.when(n <= 2, F.substring(t, 1, 1)).otherwise(F.substring(t, F.lit(1), F.greatest(F.lit(2), F.least(n - 1, F.ceil(n * 0.6).cast("int")))))
