"""Quality rules, line first: lines are judged on their own, failing lines are removed, and a
document that loses too much of its text is rejected.

A line (text between ``\\n``) that holds a word fails when any rule of ``LineRules`` is met:

* punctuation: exclamation marks on too many words, or symbols ``#*$%&|<>`` on too many words;
* navigation: ``|`` separators on too many words, or a short line without closing punctuation;
* boilerplate: a stock phrase of a web page, or an exact repetition of an earlier line of the
  document.

Lines without a word stay as they are. Base rules (``base_failed``) read the text as it came: fewer
than 20 words, or over 30 % of the words inside 8-word windows that occur more than once.

Defined results: a null text counts as empty (``base_failed``, not kept, empty ``clean_text``); repeated
rows are judged one by one; other columns pass through, an equal name gets a leading underscore only
inside the operator. One scan, no shuffle: a document never leaves its task, and a task holds a few
megabytes of text at a time whatever the length of the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plantlog.llm.common import ByteTexts, chunks

SYMBOLS = b"#*$%&|<>"
CLOSERS = b".!?:;\"')]}"
#: Stock phrases of web pages, compared without case.
PHRASES = ("all rights reserved", "privacy policy", "terms of use", "terms of service",
           "cookie policy", "use cookies", "enable javascript", "lorem ipsum", "click here",
           "read more", "sign up now", "subscribe to our newsletter", "powered by", "back to top")
_PHRASES = [p.encode() for p in PHRASES]
_SYMBOL, _CLOSER = np.zeros(256, bool), np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_CLOSER[list(CLOSERS)] = True
#: Bytes from 128 on end a word too: closing quotes and full stops of other scripts.
_CLOSER[128:] = True


@dataclass(frozen=True)
class LineRules:
    """Shares are percentages of the line's words."""

    exclaim_pct: int = 30
    symbol_pct: int = 30
    separator_pct: int = 30
    short_words: int = 4
    #: A document that loses more than this percentage of its word characters is rejected.
    max_lost_pct: int = 40


RULES = LineRules()
MIN_WORDS, WINDOW, MAX_REPEAT_PCT = 20, 8, 30


def _counts(total: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return total[hi] - total[lo]


def _running(flags: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))


def repeated_words(t: ByteTexts) -> np.ndarray:
    """Words of each document inside windows of ``WINDOW`` words found more than once in it."""
    first, h = t.windows(WINDOW)
    covered = np.zeros(len(t.word_hash) + 1, np.int64)
    if len(h):
        keyed = h + t.word_doc[first].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        order = np.argsort(keyed, kind="stable")
        same = keyed[order][1:] == keyed[order][:-1]
        again = np.zeros(len(order), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        np.add.at(covered, first[again], 1)
        np.add.at(covered, first[again] + WINDOW, -1)
    inside = np.cumsum(covered[:-1]) > 0
    total = _running(inside)
    return _counts(total, t.word_offsets[:-1], t.word_offsets[1:])


def judge(t: ByteTexts, rules: LineRules = RULES) -> dict[str, list]:
    data, docs = t.data, len(t)
    starts, ends = t.words
    chars = (data & 0xC0) != 0x80
    n_words = np.diff(t.word_offsets)
    word_chars = t.per_doc(chars & ~t.space)

    # lines: a document of k newlines has k + 1
    breaks = np.flatnonzero(data == 10)
    lo = np.sort(np.concatenate((t.offsets[:-1], breaks + 1)))
    break_doc = np.searchsorted(t.offsets, breaks, "right") - 1
    doc = np.sort(np.concatenate((np.arange(docs), break_doc)))
    hi = np.sort(np.concatenate((t.offsets[1:], breaks)))
    first, last = np.searchsorted(starts, lo), np.searchsorted(starts, hi)
    words = last - first
    full = np.flatnonzero(words > 0)

    keyed = t.hashes(lo[full], hi[full]) + doc[full].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    order = np.argsort(keyed, kind="stable")
    repeated = np.zeros(len(lo), bool)
    repeated[full[order[1:][keyed[order][1:] == keyed[order][:-1]]]] = True

    end_byte = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    exclaims = _counts(_running(end_byte == 33), first, last)
    symbols = _counts(_running(_SYMBOL[data]), lo, hi)
    pipes = _counts(_running(data == 124), lo, hi)
    closes = np.zeros(len(lo), bool)
    closes[full] = _CLOSER[end_byte[last[full] - 1]]
    stock = np.zeros(len(lo), bool)
    folded = data.tobytes().lower()
    for phrase in _PHRASES:
        at = folded.find(phrase)
        while at >= 0:
            line = np.searchsorted(lo, at, "right") - 1
            stock[line] |= at + len(phrase) <= hi[line]
            at = folded.find(phrase, at + 1)
    failed = (words > 0) & (
        repeated | stock | (100 * exclaims > rules.exclaim_pct * words)
        | (100 * symbols > rules.symbol_pct * words) | (100 * pipes > rules.separator_pct * words)
        | (~closes & (words < rules.short_words)))

    line_chars = _counts(_running(chars & ~t.space), lo, hi)
    lost = np.bincount(doc, weights=line_chars * failed, minlength=docs).astype(np.int64)
    repeat = repeated_words(t)
    base_failed = (n_words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PCT * n_words)
    line_range = np.searchsorted(doc, np.arange(docs + 1))
    clean = []
    for i in range(docs):
        a, b = line_range[i], line_range[i + 1]
        if failed[a:b].any():
            clean.append(b"\n".join(data[lo[k]:hi[k]].tobytes() for k in range(a, b)
                                    if not failed[k]))
        else:
            clean.append(t.text(i))
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": t.per_doc(_SYMBOL[data]),
        "n_dup_lines": np.bincount(doc, weights=repeated, minlength=docs).astype(np.int64),
        "n_repeat_words": repeat, "base_failed": base_failed,
        "kept": ~base_failed & (100 * lost <= rules.max_lost_pct * word_chars),
        "n_lines_removed": np.bincount(doc, weights=failed, minlength=docs).astype(np.int64),
        "clean_text": clean}


FIELDS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, n_lines_removed long, clean_text string")
NAMES = [f.split()[0] for f in FIELDS.split(", ")]


def apply_rules(docs: DataFrame, text: str = "text", rules: LineRules = RULES,
                clean: bool = True) -> DataFrame:
    """``docs`` with one struct column ``quality`` of ``FIELDS``; ``clean=False`` leaves
    ``clean_text`` null, for callers that want figures only."""
    keep = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        for batch in batches:
            for lo, hi, t in chunks(batch.column("text")):
                got = judge(t, rules)
                if not clean:
                    got["clean_text"] = [None] * len(t)
                arrays = [pa.array(got[n], pa.string() if n == "clean_text" else None)
                          if n != "clean_text" else pa.array(got[n], pa.binary()).cast(pa.string())
                          for n in NAMES]
                kind = kind or [a.type for a in arrays]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(lo, hi - lo),
                     pa.StructArray.from_arrays(arrays, NAMES)], ["row", "quality"])

    out = keep.mapInArrow(run, f"row {keep.schema['row'].dataType.simpleString()}, "
                               f"quality struct<{FIELDS.replace(' ', ':').replace(',:', ',')}>")
    return out
