"""Fill-in-middle: cut points by unit, found from the sparse events that an Aho-Corasick automaton reports."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from hashlib import sha256
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
#: Characters that end a word; all others are parts of words.
SPACES = " \t\n\v\f\r"
#: Share of documents in a hundred that are cut, and of these the share whose suffix comes first; seed of the draws.
RATE, SPM_RATE, SEED = 50, 80, 42
#: Characters of output to a batch, about.
_BATCH_CHARS = 8 << 20


def scanner(sentinels: tuple[str, ...] = SENTINELS) -> ahocorasick.Automaton:
    """One automaton for the characters that end words (value 0) and the sentinels (value 1)."""
    a = ahocorasick.Automaton()
    for c in SPACES:
        a.add_word(c, 0)
    for s in sentinels:
        a.add_word(s, 1)
    a.make_automaton()
    return a


def scan(automaton: ahocorasick.Automaton, text: str) -> tuple[np.ndarray, bool]:
    """Positions of the characters that end words, with the text's end, and whether a sentinel occurs."""
    events = np.fromiter(chain.from_iterable(automaton.iter(text)), np.int64).reshape(-1, 2)
    sentinel = events[:, 1] > 0
    return np.append(events[~sentinel, 0], len(text)), bool(sentinel.any())


def unit_ends(spaces: np.ndarray, length: int) -> np.ndarray:
    """Where each unit ends: white space and the word after it, or white space at the text's end.

    Between two events without a gap there is no word; a gap of any width is one word, and so one unit.
    So a unit ends at each event that a gap precedes, and at the text's end if white space precedes that.
    """
    ends = spaces[np.diff(spaces, prepend=-1) > 1]
    return np.append(ends, length) if length and (not len(ends) or ends[-1] < length) else ends


def draws(doc_id: int | None, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of a document: the first digits of the SHA-256 of ``seed:id`` (null id: nothing)."""
    digest = sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def transform(automaton: ahocorasick.Automaton, doc_id: int | None, text: str, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple:
    """(units, form, characters of the prefix, of the middle, output)."""
    spaces, marked = scan(automaton, text)
    ends = unit_ends(spaces, len(text))
    n = len(ends)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or marked or h3 % 100 >= rate:
        return n, "plain", None, None, text
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (int(ends[k - 1]) if k else 0 for k in (first, last))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_rate:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def _transformed(batches: Iterator[pa.RecordBatch], schema: pa.Schema, **options) -> Iterator[pa.RecordBatch]:
    automaton = scanner()
    rows, held = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    for b in batches:
        for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            rows.append((i, *transform(automaton, i, text.as_py() or "", **options)))
            held += len(rows[-1][-1]) + 64
            if held >= _BATCH_CHARS:
                yield batch()
                rows, held = [], 0
    if rows:
        yield batch()


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """Documents with a middle to fill in: id_col, n (units), form (plain, psm, spm), prefix_chars, middle_chars,
    output.

    One pass of an Aho-Corasick automaton over a text reports the white-space characters, at which words
    end, and sentinels; units are counted by the gaps between events, and the places of two of them, drawn
    from a hash of the id, are looked up by rank. ``rate`` of a hundred documents are cut; of these
    ``spm_rate`` of a hundred give the suffix first. Texts that hold a sentinel stay plain, so that outputs
    can be undone (restored()).

    Null texts count as empty and stay plain; a null id draws as an empty one. Ids are integers; repeated
    rows are each transformed alike. Texts count whole, whatever their length: memory is some 20 bytes for
    each white-space character of one text. No row moves: each task reads its documents and gives them out.
    An empty table gives an empty result; other columns are not read, whatever their names.
    """
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = d.schema["id"].dataType.simpleString()
    fields = [("id", _ARROW[id_type]), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())]
    out = d.mapInArrow(partial(_transformed, schema=pa.schema(fields), seed=seed, rate=rate, spm_rate=spm_rate), f"id {id_type}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")
    return out.withColumnRenamed("id", id_col)


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "string": pa.string()}


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. Sentinels begin with ``<`` and end with ``>`` and none is in the text,
    so an output that isn't plain has each of them once."""
    parts = F.split(output, "|".join(SENTINELS))
    first, second, third = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return F.when(form == "psm", F.concat(first, third, second)).when(form == "spm", F.concat(second, third, first)).otherwise(output)
