"""Quality rules: base counts of a text, and cross-document line frequency.

Lines are normalised (ASCII lower case, words joined by one space) and hashed to 64 bits; a line counts once for each
document. Lines found in more than ``max_docs`` documents of a host are removed there, lines found in more than
``max_all`` documents of all hosts are removed everywhere; neither number depends on how large a host is (a caller may
ask for a share of the host's documents besides). Documents that then keep less than ``keep_share`` of their words are
depleted.

``clean`` adds each kept text less its removed lines. Only texts that lose lines are shuffled, to meet the hashes of
what they lose; a bit table of fixed size tells the others, which pass as they are.

One pass over the texts yields the counts and, for each document, arrays of its distinct lines' hashes and of the
words they hold; that table is cut, with the texts if they are wanted. Counting is a partial aggregation by (host, line), so a line that a third of all
documents share costs each task one row. Only lines above the limits are joined back, and what they take from a
document is summed by document number.

Defined results: a null text is empty: no words, no lines, ``base_failed``. Null hosts form one host. Lines without a
word don't count. Very long texts are counted and cleaned whole. A line in exactly as many documents as a limit stays.
Each row is a document of its own, repeated ids included. Other columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import coded, cut, marked, slices, split_words, starts

MAX_DOCS, MAX_ALL, KEEP_SHARE = 6, 12, 0.5
MIN_WORDS = 50
_SYMBOLS = r"[#*$%&|<>]"
_SCHEMA = "row long, doc_id {id}, host {host}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<long>, line_words array<int>"


def repeated_words(code: np.ndarray, n: np.ndarray, distinct: int) -> np.ndarray:
    """For each row, words inside 3-word windows that the row holds twice or more. ``code``: all rows' words, in turn."""
    out, at = np.zeros(len(n), np.int64), starts(n)
    if len(code) < 3:
        return out
    wide = distinct + 1 >= 1 << 21
    window = code[:-2] * np.int64(0 if wide else (distinct + 1) ** 2) + code[1:-1] * np.int64(0 if wide else distinct + 1) + code[2:]
    for i in np.flatnonzero(n >= 4).tolist():
        a, b = at[i], at[i + 1] - 2
        w = np.unique(np.stack([code[a:b], code[a + 1 : b + 1], code[a + 2 : b + 2]], axis=1), axis=0, return_inverse=True)[1].ravel() if wide else window[a:b]
        order = np.argsort(w, kind="stable")
        s = w[order]
        same = s[1:] == s[:-1]
        if same.any():
            twice = np.zeros(len(w), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            covered = np.zeros(len(w) + 2, bool)
            for k in range(3):
                covered[k : k + len(w)] |= twice
            out[i] = covered.sum()
    return out


def line_hash(words: list[bytes]) -> int:
    h = xxhash.xxh3_64_intdigest(b" ".join(words).lower())
    return h - (1 << 64) if h >> 63 else h


def without(text: str, lines: set[int]) -> str:
    """The text less the lines with these hashes; all else stays as it is."""
    kept = [x for x in text.encode("utf-8", "surrogatepass").split(b"\n") if line_hash(x.split()) not in lines or not x.split()]
    return b"\n".join(kept).decode("utf-8", "surrogatepass")


def line_counts(text: str | None) -> tuple[int, list[int], list[int]]:
    """Repeated lines; hashes and words of distinct normalised lines, each with all its occurrences' words."""
    seen, raw, repeats = {}, set(), 0
    for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
        words = line.split()
        if words:
            repeats += line in raw
            raw.add(line)
            h = line_hash(words)
            seen[h] = seen.get(h, 0) + len(words)
    return repeats, list(seen), list(seen.values())


def counts(docs: DataFrame, host: str = "source", with_text: bool = False) -> DataFrame:
    """Base counts and lines of every row, numbered by ``row``; with the text if wanted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for batch in slices(batches):
            texts = batch.column(2)
            words, n = split_words(texts)
            code, distinct = coded(words)
            chars = np.asarray(pc.utf8_length(distinct), dtype=np.int64)[code] if len(code) else code
            at = starts(n)
            total = np.concatenate([[0], np.cumsum(chars)])
            lines = [line_counts(t) for t in texts.to_pylist()]
            symbols = pc.fill_null(pc.count_substring_regex(texts, _SYMBOLS), 0)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(row, row + len(n))),
                    batch.column(0),
                    batch.column(1),
                    pa.array(n.astype(np.int64)),
                    pa.array((total[at[1:]] - total[at[:-1]]).astype(np.int64)),
                    symbols.cast(pa.int64()),
                    pa.array([x[0] for x in lines], pa.int64()),
                    pa.array(repeated_words(code, n, len(distinct))),
                    pa.array([x[1] for x in lines], pa.list_(pa.int64())),
                    pa.array([x[2] for x in lines], pa.list_(pa.int32())),
                    *([texts] if with_text else []),
                ],
                ["row", "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines", "line_words", *(["text"] if with_text else [])],
            )
            row += len(n)

    rows = docs.select("doc_id", F.col(host).alias("host"), "text")
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    return cut(rows.mapInArrow(count, _SCHEMA.format(id=kind["doc_id"], host=kind["host"]) + ", text string" * with_text), "lines")


def frequent(rows: DataFrame, max_docs: int, max_all: int, max_share: float) -> DataFrame:
    """(host, line, n): the lines above the limits, for each host that has them. ``n``: the host's documents with it."""
    of_host = rows.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count("*").alias("n"))
    everywhere = of_host.groupBy(F.col("line").alias("l")).agg(F.sum("n").alias("all")).where(F.col("all") > max_all)
    many = F.col("n") > max_docs
    if max_share:
        per_host = rows.groupBy(F.col("host").alias("h")).agg((F.count("*") * F.lit(max_share)).alias("most"))
        of_host = of_host.join(per_host, F.col("host").eqNullSafe(F.col("h")))
        many &= F.col("n") > F.col("most")
    return of_host.join(everywhere, F.col("line") == F.col("l"), "left").where(many | F.col("all").isNotNull()).select("host", "line", "n")


def judge(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS, max_share: float = 0.0, keep_share: float = KEEP_SHARE, max_all: int = MAX_ALL) -> DataFrame:
    """Base counts with base_failed, words_removed (those of lines above the limits) and kept, for every row."""
    rows = counts(docs, host)
    lost = losses(rows, max_docs, max_all, max_share).drop("removed")
    return verdict(rows.join(lost, F.col("row") == F.col("r"), "left"), keep_share).drop("row", "r", "lines", "line_words")


def losses(rows: DataFrame, max_docs: int, max_all: int, max_share: float) -> DataFrame:
    """(r, words_removed, removed): what rows lose, by their numbers, those that lose something; and the hashes of the lines."""
    often = frequent(rows, max_docs, max_all, max_share).select(F.col("host").alias("h"), F.col("line").alias("often"))
    lines = rows.select("row", "host", F.explode(F.arrays_zip("lines", "line_words")).alias("l")).select("row", "host", F.col("l.lines").alias("line"), F.col("l.line_words").alias("words"))
    lost = lines.join(often, F.col("host").eqNullSafe(F.col("h")) & (F.col("line") == F.col("often")))
    return lost.groupBy(F.col("row").alias("r")).agg(F.sum("words").alias("words_removed"), F.collect_list("line").alias("removed"))


def verdict(rows: DataFrame, keep_share: float) -> DataFrame:
    """``rows``, with words_removed null where nothing is, with base_failed and kept."""
    rows = rows.withColumn("words_removed", F.coalesce("words_removed", F.lit(0)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    depleted = F.col("n_words") - F.col("words_removed") < keep_share * F.col("n_words")
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)


def clean(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS, max_share: float = 0.0, keep_share: float = KEEP_SHARE, max_all: int = MAX_ALL) -> DataFrame:
    """What ``judge`` gives for every row, and ``text``: a kept row's text less its removed lines, null for other rows."""
    rows = counts(docs, host, with_text=True)
    lost = cut(losses(rows, max_docs, max_all, max_share), "lost")
    texts = marked(rows.drop("lines", "line_words"), "row", lost.select("r"), "losing")
    # what is lost grows with the input, so it is never broadcast, not even where it is small
    losing = texts.where("losing").join(lost.hint("merge"), F.col("row") == F.col("r"), "left").drop("r")
    whole = texts.where("not losing").withColumns({"words_removed": F.lit(None).cast("long"), "removed": F.lit(None).cast("array<long>")})
    found = [verdict(x.drop("row", "losing"), keep_share) for x in (losing, whole)]
    names = [c for c in found[0].columns if c not in ("text", "removed")]
    some = found[0].select(*names, "removed", F.when(F.col("kept"), F.col("text")).alias("text"))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            removed, text = part.column(len(names)), part.column(len(names) + 1)
            cutting = np.asarray(pc.and_(pc.fill_null(pc.greater(pc.list_value_length(removed), 0), False), text.is_valid()))
            if cutting.any():
                left = [without(t, set(r)) for t, r in zip(text.filter(cutting).to_pylist(), removed.filter(cutting).to_pylist(), strict=True)]
                text = pc.replace_with_mask(text, pa.array(cutting), pa.array(left, text.type))
            yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], text], [*names, "text"])

    out = some.mapInArrow(rewrite, some.drop("removed").schema)
    return out.unionByName(found[1].select(*names, F.when(F.col("kept"), F.col("text")).alias("text")))


def remove_lines(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS, max_share: float = 0.0, max_all: int = MAX_ALL) -> DataFrame:
    """(host, line, n): hashes of the lines above the limits, as ``clean`` removes them."""
    return frequent(counts(docs, host), max_docs, max_all, max_share)
