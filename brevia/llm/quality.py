"""Quality rules: base counts, and a linear-chain conditional random field that labels lines."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brevia.llm.common import slices, table

#: Labelled documents that the field is fitted on at most, by order of a hash.
TRAIN_ROWS = 3_000
#: Lines of a training sequence; longer documents make several.
TRAIN_LINES = 32
#: Such sequences that the field is fitted on at most, and so some 30 MB that come to the driver, however long the documents are.
TRAIN_SEQUENCES = 20_000
#: Share of a document's characters in content lines from which it is kept.
LEAST_CONTENT = 0.5

FEATURES = ("symbols", "capitals", "exclamations", "bars", "repeated_words", "earlier_line", "few_words", "digits", "no_letters", "no_stop")

_WORD, _SYMBOL = re.compile(r"[^\x20\x09-\x0D]+"), "#*$%&|<>"
_NOISE, _UPPER, _DIGIT = re.compile(r"[#*$%&<>]"), re.compile(r"[^\W\d_a-zß-öø-ÿ]"), re.compile(r"\d")


def line_features(lines: list[str]) -> np.ndarray:
    """A row of FEATURES for each line; a line is compared with those before it."""
    out = np.zeros((len(lines), len(FEATURES)))
    seen: set[str] = set()
    for row, line in zip(out, lines, strict=True):
        words = _WORD.findall(line)
        n, size = len(words), len(line) or 1
        letters = sum(map(str.isalpha, line))
        row[0] = min(1.0, 4 * len(_NOISE.findall(line)) / size)
        row[1] = len(_UPPER.findall(line)) / letters if letters else 0.0
        row[2] = min(1.0, line.count("!") / n) if n else 0.0
        row[3] = min(1.0, 3 * line.count("|") / n) if n else 0.0
        row[4] = 1 - len(set(words)) / n if n else 0.0
        row[5] = line in seen
        row[6] = n < 3
        row[7] = len(_DIGIT.findall(line)) / size
        row[8] = letters == 0
        row[9] = not line.rstrip().endswith((".", "!", "?", ":", '"', "»"))
        if n:
            seen.add(line)
    return out


@dataclass
class LineField:
    """Scores of label content (1) against boilerplate (0): ``emit`` weighs features, ``bias`` stands alone, ``move[a, b]`` goes from a to b."""

    emit: np.ndarray
    bias: float
    move: np.ndarray

    def viterbi(self, features: np.ndarray) -> np.ndarray:
        """The best sequence of labels; of equally good ones, content late rather than early."""
        score = features @ self.emit + self.bias
        n = len(score)
        back = np.zeros((n, 2), dtype=np.int8)
        (m00, m01), (m10, m11) = self.move.tolist()
        a, b = 0.0, 0.0
        for i, s in enumerate(score.tolist()):
            if i:
                from0, from1 = (a + m00, b + m10), (a + m01, b + m11)
                back[i] = from0[1] > from0[0], from1[1] > from1[0]
                a, b = max(from0), max(from1)
            b += s
        out = np.zeros(n, dtype=np.int8)
        if n:
            out[-1] = b >= a
            for i in range(n - 1, 0, -1):
                out[i - 1] = back[i, out[i]]
        return out


def _fit_field(seqs: list[tuple[np.ndarray, np.ndarray]], chain: bool, start: LineField | None = None, rounds: int = 150, l2: float = 0.02) -> LineField:
    """Maximum likelihood with an L2 penalty, by gradient steps (Adam) on padded sequences."""
    t = max(len(y) for _, y in seqs)
    x = np.zeros((len(seqs), t, len(FEATURES)))
    y, mask = np.zeros((len(seqs), t), dtype=int), np.zeros((len(seqs), t))
    for i, (fx, fy) in enumerate(seqs):
        x[i, : len(fy)], y[i, : len(fy)], mask[i, : len(fy)] = fx, fy, 1
    w = np.zeros(len(FEATURES) + 1 + 4)
    if start is not None:
        w[:-4] = [*start.emit, start.bias]
    m, v = np.zeros_like(w), np.zeros_like(w)
    both = mask[:, 1:] * mask[:, :-1]
    pairs = np.zeros((2, 2))
    for a in (0, 1):
        for b in (0, 1):
            pairs[a, b] = (both * (y[:, :-1] == a) * (y[:, 1:] == b)).sum()
    for step in range(1, rounds + 1):
        s = np.zeros((*y.shape, 2))
        s[..., 1] = x @ w[: len(FEATURES)] + w[len(FEATURES)]
        move = w[-4:].reshape(2, 2)
        fwd, bwd = np.zeros_like(s), np.zeros_like(s)
        fwd[:, 0] = s[:, 0]
        for i in range(1, t):
            now = np.logaddexp(fwd[:, i - 1, 0, None] + move[0], fwd[:, i - 1, 1, None] + move[1]) + s[:, i]
            fwd[:, i] = np.where(mask[:, i, None] > 0, now, fwd[:, i - 1])
        for i in range(t - 2, -1, -1):
            ahead = bwd[:, i + 1] + s[:, i + 1]
            now = np.logaddexp(ahead[:, 0, None] + move[:, 0], ahead[:, 1, None] + move[:, 1])
            bwd[:, i] = np.where(mask[:, i + 1, None] > 0, now, 0.0)
        z = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
        p1 = np.exp(fwd[..., 1] + bwd[..., 1] - z[:, None])
        grad = np.zeros_like(w)
        off = (y - p1) * mask
        grad[: len(FEATURES)] = np.einsum("st,std->d", off, x)
        grad[len(FEATURES)] = off.sum()
        if chain:
            joint = fwd[:, :-1, :, None] + move[None, None] + (s + bwd)[:, 1:, None, :] - z[:, None, None, None]
            grad[-4:] = (pairs - (np.exp(joint) * both[..., None, None]).sum((0, 1))).ravel()
        grad = grad / mask.sum() - l2 * 0.01 * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w = w + 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return LineField(w[: len(FEATURES)], float(w[len(FEATURES)]), w[-4:].reshape(2, 2))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = TRAIN_ROWS, max_sequences: int = TRAIN_SEQUENCES, seed: int = 0) -> LineField:
    """Fit the field on at most ``max_rows`` labelled documents, the first by a hash of the id, and ``max_sequences`` of TRAIN_LINES lines of theirs, the first by a hash of id and place.

    Labels are of documents, so lines are labelled in two passes: first each line has its document's label and the
    field no transitions; then those lines of bad documents that look like content become content, and the chain is
    fitted. Null ids, texts and labels are left out. Unless both labels occur, every line is content.
    """
    sample = (
        labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label"))
        .filter("__id is not null and __label is not null")
        .groupBy("__id").agg(F.max("__label").alias("__label"))
        .orderBy(F.xxhash64("__id", F.lit(seed)), "__id").limit(max_rows)
    )
    # max_rows bounds what is broadcast, and max_sequences the features of lines, rather than texts, that come to the driver
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(sample), "__id").filter("__text is not null")

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches):
            out = []
            for i, label, t in zip(b["__id"].astype(str), b["__label"], b["__text"], strict=True):
                x = line_features(t.split("\n")).astype(np.float32)
                out += [(i, at, label, x[at : at + TRAIN_LINES].ravel().tolist()) for at in range(0, len(x), TRAIN_LINES)]
            yield pd.DataFrame({c: pd.Series([r[k] for r in out], dtype=t) for k, (c, t) in enumerate((("__id", object), ("__at", "int64"), ("__label", "int64"), ("x", object)))})

    got = rows.select("__id", "__label", "__text").mapInPandas(features, "__id string, __at bigint, __label bigint, x array<float>")
    got = got.orderBy(F.xxhash64("__id", "__at", F.lit(seed)), "__id", "__at").limit(max_sequences).toPandas().sort_values(["__id", "__at"], kind="stable")
    if got["__label"].nunique() < 2:
        return LineField(np.zeros(len(FEATURES)), 1.0, np.zeros((2, 2)))
    found = [np.asarray(x, dtype=float).reshape(-1, len(FEATURES)) for x in got["x"]]
    seqs = [(x, np.full(len(x), int(label > 0))) for x, label in zip(found, got["__label"], strict=True)]
    plain = _fit_field(seqs, chain=False)
    seqs = [(x, np.where(x @ plain.emit + plain.bias > 0, 1, 0) if not y[0] else y) for x, y in seqs]
    return _fit_field(seqs, chain=True, start=plain)


def base_counts(text: str, words: list[str]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif _WORD.search(line):
            seen.add(line)
    repeat = 0
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) < len(windows):
        end = 0
        for i, w in enumerate(windows):
            if counts[w] > 1:
                repeat += i + 3 - max(i, end)
                end = i + 3
    return sum(map(len, words)), sum(text.count(c) for c in _SYMBOL), dup, repeat


_SCHEMA = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, content_share double, content_lines array<int>, kept boolean"


def quality_rules(docs: DataFrame, field: LineField, text_col: str = "text", least_content: float = LEAST_CONTENT, out: str = "quality") -> DataFrame:
    """Add struct ``out``: base counts, base_failed, content_share, content_lines (from 0) and kept.

    A document fails by the base rules with fewer than 50 words, or with over half its words in windows of three
    that occur again. Others are kept if the field's best labelling of their lines gives content at least the share
    ``least_content`` of their characters. A null or empty text has no words and fails. Each row is judged alone,
    over its whole text; other columns stay and may have any names but ``out``.
    """

    @F.pandas_udf(_SCHEMA)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                text = text or ""
                words = _WORD.findall(text)
                chars, symbols, dup, repeat = base_counts(text, words)
                failed = len(words) < 50 or 100 * repeat > 50 * len(words)
                lines = text.split("\n")
                label = field.viterbi(line_features(lines))
                size = np.array([len(x) for x in lines])
                share = float(size @ label / size.sum()) if size.sum() else 0.0
                rows.append((len(words), chars, symbols, dup, repeat, failed, share, np.flatnonzero(label).tolist(), not failed and share >= least_content))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _SCHEMA.split(", ")])

    return docs.withColumn(out, judge(F.col(text_col)))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of each row; a null text is empty and fails, as texts of fewer than 50 words do."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    field = fit(docs, table(spark, sf_dir, "labels"))
    d = quality_rules(docs, field, out="q").select("doc_id", "q.*")
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("content_share", 6).alias("content_share"))
