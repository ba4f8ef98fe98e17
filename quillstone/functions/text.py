"""Column expressions for text: cleaning, tokens, sentences, hashing. All are built-in functions, so they stay in whole-stage code generation."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that are objects of Python at a time.
NFKC_ROWS = 256
# Stopwords of the citation check.
CITATION_STOPWORDS = """the a an is are was were be been being to of and or in on for up at by with can could will would this that it its has
have had between from as than then into about""".split()
# Stopwords of generation and its evaluation.
CONTENT_STOPWORDS = """the a an is are was were be been being of to in on for and or with as at by from that this these those it its which what who
how when where why does do did can will would should has have had you your i me my we our they their them he she his her about into than then so
such not no any all each per use used using up out over there""".split()
# Words dropped when a query is broadened.
BROADEN_STOPWORDS = """what is are the a an how do does did i to of for define explain describe which can with on in and or about tell me""".split()


def strip(c: Column) -> Column:
    """Without white space at both ends, line breaks included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def one_space(c: Column) -> Column:
    """Runs of white space as one space, ends stripped."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def words(c: Column) -> Column:
    """Lower-case runs of a-z and 0-9."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def plain(c: Column) -> Column:
    """The text whose runs of a-z and 0-9 are its words: what `split_words` takes."""
    return F.lower(F.coalesce(c, F.lit("")))


IN_WORDS = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8))
NO_SPACE = np.arange(256) != ord(" ")


def split_words(texts: pa.StringArray, inside: np.ndarray = IN_WORDS) -> pa.ListArray:
    """`words` of lower-cased texts without nulls, by array operations on their bytes: maximal runs of the bytes that are `inside`."""
    n, none = len(texts), pa.array([[]] * len(texts), pa.list_(pa.string()))
    _, offsets, data = texts.buffers()
    if not n or data is None:
        return none
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data, at = np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]
    keep = inside[data]
    begins, ends = keep.copy(), keep.copy()
    begins[1:] &= ~keep[:-1]
    ends[:-1] &= ~keep[1:]
    edge = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(data))]  # a word does not go on in the next text
    begins[edge], ends[edge - 1] = keep[edge], keep[edge - 1]
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends)
    if not len(begin):
        return none
    places = np.append(0, np.cumsum(end + 1 - begin)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(begin), pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(data[keep])))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(begin, at).astype(np.int32)), words)


def word_runs(c: Column) -> Column:
    """Lower-case runs of letters and digits of any script and underscores."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def content_words(c: Column) -> Column:
    """Lower-case words, hyphens inside kept, without stopwords; repeats stay."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[a-z0-9][a-z0-9\-]*"), F.lit(0))
    return without(found, CONTENT_STOPWORDS)


def without(items: Column, dropped: list[str]) -> Column:
    return F.filter(items, lambda w: ~w.isin(dropped))


def sentences(c: Column) -> Column:
    """Pieces between white space that follows . ! or ?"""
    return F.split(c, r"(?<=[.!?])\s+")


def nfkc(c: Column) -> Column:
    """Unicode compatibility composition, which Spark has no function for."""

    def some(part: pa.Array) -> pa.Array:
        if pc.all(pc.string_is_ascii(part), min_count=0).as_py():  # nothing to compose
            return part
        return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in part.to_pylist()], part.type)

    def run(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([some(texts.slice(at, NFKC_ROWS)) for at in range(0, max(len(texts), 1), NFKC_ROWS)])

    return F.arrow_udf(run, "string")(c)


def clean(c: Column, normalise: bool = False) -> Column:
    """Page text without control characters, page numbers, hyphenated line breaks and surplus white space. NFKC only if asked for: it needs Python."""
    c = nfkc(c) if normalise else c
    c = F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    c = F.regexp_replace(c, r"(?m)^\s*\d+\s*$", "")
    c = F.regexp_replace(c, r"(?i)Page\s+\d+\s+of\s+\d+", "")
    c = F.regexp_replace(c, r"(?m)^\s*-\s*\d+\s*-\s*$", "")
    c = F.regexp_replace(c, r"(?U)(?<=\w)-\n(?=\w)", "")  # one pass with lookaround is the fixpoint
    c = F.regexp_replace(c, r"[ \t]+", " ")
    c = F.regexp_replace(c, r"(?m)[\s&&[^\n]]+$", "")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def token_estimate(c: Column) -> Column:
    """Tokens of a text where no tokenizer is at hand: a quarter of its length and two, none for an empty one."""
    return F.when(F.length(c) == 0, 0).otherwise(F.floor(F.length(c) / 4) + 2).cast("int")


def short_sha(c: Column, n: int = 32) -> Column:
    return F.substring(F.sha2(c, 256), 1, n)


def chunk_id(doc: Column, start: Column, end: Column) -> Column:
    return short_sha(F.concat_ws(":", doc.cast("string"), start.cast("string"), end.cast("string")))


def hash_bucket(token: Column, dim: int = 384) -> Column:
    """The first eight bytes of the token's MD5, read as a little-endian integer, modulo dim."""
    h = F.md5(token)
    half = lambda at: F.conv(F.concat(*[F.substring(h, i, 2) for i in range(at + 6, at - 1, -2)]), 16, 10).cast("bigint") % dim
    return ((half(9) * ((1 << 32) % dim) + half(1)) % dim).cast("int")
