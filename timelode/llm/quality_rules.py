"""Quality rules by line labelling: a linear-chain conditional random field over
the lines of a text, decoded by Viterbi, calls each line content or boilerplate;
the share of words on content lines decides whether the document stays.

Weights are trained on a bounded sample of labelled documents
(``sample_rows``): all their lines carry the document's quality as a weak label and
the field is fitted by exact forward-backward gradients. Tasks work out the
gradients of the sampled rows; the driver gets their sums, a dozen numbers a round.
Without two kinds of labels ``DEFAULT`` holds. Everything else covers every row
and whole texts.

Defined results: a null or empty text has no words, no lines and fails the base
rule; a share of exactly ``MIN_SHARE`` is kept, and a line that is as good either way
counts as content; rows are judged one by one, so repeated rows get equal results;
texts of any length are judged whole, in time linear in their length; an empty
table gives an empty result. ``annotate`` carries other columns unless their name is
one of this operator's own, which then holds its value; ``kept_rows`` returns every
input column as it was.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import chunks, with_found
from .common import own_name, stored
from .shingles import _SPACE, windows_of, words_of

MIN_WORDS, WINDOW = 10, 5
REPEAT_PERCENT = 20
MIN_SHARE = 0.5
SAMPLE_ROWS = 600
ROUNDS = 40

_SYMBOL, _UPPER, _LETTER, _DIGIT, _PIPE, _POINT, _LEAD = (np.zeros(256, bool) for _ in range(7))
_SYMBOL[list(b"#*$%&|<>!~^{}[]\\=_")] = True
_BASE_SYMBOL = np.zeros(256, bool)
_BASE_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[0xC0:] = True
_DIGIT[48:58] = True
_PIPE[ord("|")] = True
_POINT[list(b".,;:?")] = True
_LEAD[:0x80] = _LEAD[0xC0:] = True

FEATURES = ("bias", "symbols", "upper", "digits", "pipes", "points", "repeated", "short", "words")


@dataclass(frozen=True)
class Field:
    """emit[f]: what a feature adds to content over boilerplate; step[a][b]: what
    a line of state a before one of state b adds (0 boilerplate, 1 content)."""

    emit: tuple[float, ...]
    step: tuple[tuple[float, float], tuple[float, float]]


#: What a feature's weight is measured in: large for features that are small shares.
UNITS = (2.0, 25.0, 4.0, 4.0, 10.0, 2.0, 3.0, 1.0, 1.0)
#: Used where labels can't train a field, and nowhere else.
DEFAULT = Field((2.0, -25.0, -4.0, -4.0, -10.0, 0.0, -3.0, -0.5, 0.5), ((0.5, -0.5), (-0.5, 0.5)))


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, np.ndarray], object]:
    """Features and word counts of all lines with a word, the first such line of
    each text, and the base figures of the texts."""
    words = words_of(texts)
    buf, doc_first = words.buf, words.byte_first
    ends = np.flatnonzero(buf == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    total = np.zeros(len(buf) + 1, np.int64)

    def per(edges: np.ndarray, mask: np.ndarray) -> np.ndarray:
        np.cumsum(mask, out=total[1:])
        return total[edges[1:]] - total[edges[:-1]]

    edges = np.append(starts, len(buf))
    space = _SPACE[buf]
    begins = ~space
    begins[1:] &= space[:-1]
    n_words = per(edges, begins)
    seen_by = np.searchsorted(doc_first, starts, "right") - 1
    filled = np.maximum(1, per(edges, ~space))
    letters = np.maximum(1, per(edges, _LETTER[buf]))
    repeated = np.zeros(len(starts), bool)
    raw, doc, seen = buf.tobytes(), -1, set()
    for i in np.flatnonzero(n_words).tolist():
        if seen_by[i] != doc:
            doc, seen = seen_by[i], set()
        line = raw[starts[i] : ends[i]]
        if line in seen:
            repeated[i] = True
        else:
            seen.add(line)
    features = np.stack(
        [
            np.ones(len(starts)),
            per(edges, _SYMBOL[buf]) / filled,
            per(edges, _UPPER[buf]) / letters,
            per(edges, _DIGIT[buf]) / filled,
            per(edges, _PIPE[buf]) / np.maximum(1, n_words),
            per(edges, _POINT[buf]) / np.maximum(1, n_words),
            repeated,
            n_words < 4,
            np.log1p(n_words) / 4,
        ],
        axis=1,
    )
    real = n_words > 0
    base = {
        "n_words": words.count(),
        "word_chars": per(doc_first, _LEAD[buf] & ~space),
        "n_symbols": per(doc_first, _BASE_SYMBOL[buf]),
        "n_dup_lines": np.bincount(seen_by[repeated], minlength=len(texts)).astype(np.int64),
    }
    line_first = np.searchsorted(seen_by[real], np.arange(len(texts) + 1))
    return features[real], n_words[real], line_first, base, words


def repeat_words(words) -> np.ndarray:
    """Words of each text that lie in 5-word windows found twice or more in it."""
    wins = windows_of(words, WINDOW)
    out = np.zeros(len(words.first) - 1, np.int64)
    for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
        n = b - a - WINDOW + 1
        if n < 2:
            continue
        own = wins[a : a + n]
        order = np.argsort(own, kind="stable")
        ranked = own[order]
        same = ranked[1:] == ranked[:-1]
        if same.any():
            twice = np.zeros(n, bool)
            twice[order[1:][same]] = twice[order[:-1][same]] = True
            ends = np.zeros(n + WINDOW, np.int64)
            hit = np.flatnonzero(twice)
            ends[hit] += 1
            ends[hit + WINDOW] -= 1
            out[i] = np.count_nonzero(np.cumsum(ends) > 0)
    return out


def viterbi(gain: list[float], step) -> list[int]:
    """Best states of one text: gain[i] is what content at line i adds over boilerplate."""
    (s00, s01), (s10, s11) = step
    bad, good, back = 0.0, gain[0], []
    for g in gain[1:]:
        to_bad, to_good = (0, bad + s00) if bad + s00 >= good + s10 else (1, good + s10), (0, bad + s01) if bad + s01 > good + s11 else (1, good + s11)
        back.append((to_bad[0], to_good[0]))
        bad, good = to_bad[1], to_good[1] + g
    state = int(good >= bad)
    path = [state]
    for pair in reversed(back):
        state = pair[state]
        path.append(state)
    return path[::-1]


def gradient(x: np.ndarray, good: int, field: Field) -> np.ndarray:
    """Of one text's log likelihood by all its lines (features x, all labelled
    ``good``), over the number of lines: for the features, then the four steps. What
    is passed on from line to line is the log odds of content, in both directions."""
    n, ((s00, s01), (s10, s11)) = len(x), field.step
    gain = x @ np.array(field.emit)
    g = gain.tolist()
    ahead, after = [g[0]], [0.0]
    e00, e01, e10, e11 = exp(s00), exp(s01), exp(s10), exp(s11)
    for v in g[1:]:
        u = exp(ahead[-1])
        ahead.append(v + log((e01 + u * e11) / (e00 + u * e10)))
    for v in g[:0:-1]:
        u = exp(v + after[-1])
        after.append(log((e10 + u * e11) / (e00 + u * e01)))
    ahead, after = np.array(ahead), np.array(after[::-1])
    content = 1 / (1 + np.exp(-(ahead + after)))
    joint = np.zeros(4)
    if n > 1:
        right = (gain + after)[1:]
        logs = np.stack([np.full(n - 1, s00), s01 + right, ahead[:-1] + s10, ahead[:-1] + s11 + right])
        odds = np.exp(logs - logs.max(0))
        joint = -(odds / odds.sum(0)).sum(1)
        joint[3 * good] += n - 1
    return np.concatenate([x.T @ (good - content), joint]) / n


def sample_lines(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """(quality, x): the features of every line of at most ``sample_rows`` labelled
    rows, drawn in the order of a hash of id and text; a stored table."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(drawn), "doc_id")
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"), "text").limit(sample_rows)

    def work(texts: list[str]) -> dict[str, list]:
        out = []
        for a, b in chunks(texts):
            features, _, first, _, _ = line_features(texts[a:b])
            out += [features[p:q].ravel() for p, q in zip(first[:-1], first[1:], strict=True)]
        return {"x": out}

    spread = rows.select("quality", "text").repartition(8, F.xxhash64("text"))
    found = with_found(spread, "text", T.StructType([T.StructField("x", T.ArrayType(T.DoubleType()))]), work)
    return stored(found.where(F.size("x") > 0), "field-sample")


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, rounds: int = ROUNDS, rate: float = 0.3, shrink: float = 0.002, shrink_step: float = 0.25) -> Field:
    """Maximum a posteriori weights under Gaussian priors about zero, by ascent with
    moments (each weight has a pace of its own) over the sampled rows. Features are
    measured in units of ``UNITS``. A step's gradient is at most 1 a text, so a step ends within
    1 / shrink_step of zero; nothing else holds it."""
    sample = sample_lines(docs, labels, sample_rows)
    seen = {r["quality"]: r["n"] for r in sample.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(seen) < 2:
        return DEFAULT
    n, size = sum(seen.values()), len(FEATURES)

    def slope(field: Field) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size + 4)
            for batch in batches:
                for x, good in zip(batch.column("x"), batch.column("quality").to_pylist(), strict=True):
                    total += gradient(x.values.to_numpy().reshape(-1, size), good, field)
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["slope"])

        return sum(np.array(r["slope"]) for r in sample.mapInArrow(run, "slope array<double>").collect()) / n

    units, pull = np.array([*UNITS, 1, 1, 1, 1], float), np.array([shrink] * size + [shrink_step] * 4)
    weights, first, second = np.zeros(size + 4), np.zeros(size + 4), np.zeros(size + 4)
    for k in range(1, rounds + 1):
        grad = slope(_field(units * weights)) * units - pull * weights
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        pace = first / (1 - 0.9**k) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
        weights = np.round(weights + rate * (1 - k / (rounds + 1)) * pace, 9)
    return _field(units * weights)


def _field(weights: np.ndarray) -> Field:
    emit, step = weights[:-4].tolist(), weights[-4:].tolist()
    return Field(tuple(emit), (tuple(step[:2]), tuple(step[2:])))


OUT = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("content_share", T.DoubleType()), T.StructField("kept", T.BooleanType())]
)


def judge(texts: list[str], field: Field) -> dict[str, np.ndarray]:
    parts = []
    for a, b in chunks(texts):
        features, line_words, first, out, words = line_features(texts[a:b])
        gain = features @ np.array(field.emit)
        share = np.zeros(b - a)
        for i, (p, q) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            if q > p:
                states = np.array(viterbi(gain[p:q].tolist(), field.step))
                own = line_words[p:q]
                share[i] = (own * states).sum() / own.sum()
        out["n_repeat_words"] = repeat_words(words)
        out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > REPEAT_PERCENT * out["n_words"])
        out["content_share"] = share
        out["kept"] = ~out["base_failed"] & (share >= MIN_SHARE)
        parts.append(out)
    return {n: np.concatenate([p[n] for p in parts]) if parts else np.zeros(0) for n in OUT.names}


def annotate(docs: DataFrame, field: Field, keep: list[str] | None = None) -> DataFrame:
    """docs with the figures and the verdict of each row; no shuffle. keep: the
    columns to carry (default: all but those named as this operator's own)."""
    own = {n.lower() for n in OUT.names}
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in own]
    text = own_name(docs, "text_")
    return with_found(docs.select(*keep, F.col("text").alias(text)), text, OUT, lambda texts: judge(texts, field))


def kept_rows(docs: DataFrame, field: Field) -> DataFrame:
    """The rows of docs that stay, as they are."""
    kept = own_name(docs, "kept_")
    found = T.StructType([T.StructField(kept, T.BooleanType())])
    name = next(c for c in docs.columns if c.lower() == "text")
    return with_found(docs, name, found, lambda texts: {kept: judge(texts, field)["kept"]}, keep_text=True).where(kept).drop(kept)
