"""Substring dedup of a corpus against itself with sharded suffix automata.

A window is ``LENGTH`` consecutive words of one text; a word goes if a window over it occurs
elsewhere too. An automaton over the whole corpus is neither buildable nor broadcastable, so the
reference is cut into shards that hold all that can match and have a bounded size:

1. Every window is owned by its minimizer, the leftmost smallest hash among its ``GRAM``-word
   grams. Equal windows have equal minimizers. Consecutive windows with one owner form a *span*,
   so each window lies in exactly one span. Only spans whose minimizer occurs twice go on.
2. Equal spans are counted, not copied. A minimizer with one distinct span is settled by its
   count; a passage in a third of all documents is one row here.
3. Where one minimizer has very many distinct spans (the borders of a very common passage), its
   windows get finer owners: the words that all windows of one half of the span share, then of one
   quarter, and so on. Equal windows have equal owners still, so each lies in one part, and a part
   whose shared words occur once goes. Halving ends with one window, where equal owners are equal
   windows, so every owner ends with few distinct parts.
4. The spans of whole minimizers are gathered to reference shards of at most ``SHARD_WORDS`` words
   (and one owner of at most ``CROWD`` spans). A task builds the shard's suffix automaton over the words themselves, with
   occurrence counts, and streams its spans for matching statistics: the longest match, ending at
   each word, that occurs at least twice. Matches of ``LENGTH`` words or more are removed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symbolgrid.llm.durable import Store
from symbolgrid.llm.words import Words, filled, mix, pieces, range_hash, tidy

LENGTH, GRAM = 35, 8
SHARD_WORDS = 60_000
#: Distinct spans that one owner may have; beyond it they are divided before they meet.
CROWD = 500


class SuffixAutomaton:
    """Of several weighted word sequences; counts are the weights of the sequences' occurrences."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.count = [0]
        self.longest_twice: list[int] = []

    def add(self, sequence: list, weight: int) -> None:
        following, link, length, count = self.next, self.link, self.length, self.count
        last = 0
        for word in sequence:
            known = following[last].get(word)
            if known is not None and length[known] == length[last] + 1:
                last = known
                count[last] += weight
                continue
            if known is not None:  # the prefix exists inside a longer class: split it
                split = len(length)
                following.append(following[known].copy())
                link.append(link[known])
                length.append(length[last] + 1)
                count.append(0)
                link[known] = split
                p = last
                while p >= 0 and following[p].get(word) == known:
                    following[p][word] = split
                    p = link[p]
                last = split
                count[last] += weight
                continue
            state = len(length)
            following.append({})
            link.append(0)
            length.append(length[last] + 1)
            count.append(weight)
            p = last
            while p >= 0 and word not in following[p]:
                following[p][word] = state
                p = link[p]
            if p >= 0:
                q = following[p][word]
                if length[q] == length[p] + 1:
                    link[state] = q
                else:
                    split = len(length)
                    following.append(following[q].copy())
                    link.append(link[q])
                    length.append(length[p] + 1)
                    count.append(0)
                    link[q] = link[state] = split
                    while p >= 0 and following[p].get(word) == q:
                        following[p][word] = split
                        p = link[p]
            last = state

    def finish(self) -> None:
        """Pass counts up the suffix links; note each state's longest suffix that occurs twice."""
        order = np.argsort(np.array(self.length), kind="stable").tolist()
        link, count, length = self.link, self.count, self.length
        for s in reversed(order[1:]):
            count[link[s]] += count[s]
        twice = self.longest_twice = [0] * len(length)
        for s in order[1:]:
            twice[s] = length[s] if count[s] >= 2 else twice[link[s]]

    def matching_statistics(self, sequence: list) -> Iterator[int]:
        """At each word the length of the longest match, ending there, that occurs twice or more."""
        following, link, length, twice = self.next, self.link, self.length, self.longest_twice
        state = size = 0
        for word in sequence:
            while state and word not in following[state]:
                state = link[state]
                size = length[state]
            if word in following[state]:
                state = following[state][word]
                size += 1
            else:
                size = 0
            found = twice[state]
            yield found if found < size else size


def matched_ranges(automaton: SuffixAutomaton, sequence: list, least: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal word ranges covered by matches of at least ``least`` words."""
    out: list[tuple[int, int]] = []
    for i, size in enumerate(automaton.matching_statistics(sequence)):
        if size >= least:
            start = i + 1 - size
            if out and start <= out[-1][1]:
                start = min(out.pop()[0], start)
            out.append((start, i + 1))
    return out


def owned_spans(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of windows, minimizer and content hash of every span of the texts."""
    n = len(words.starts)
    if n < LENGTH:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    at, grams = words.windows(GRAM)
    low = np.full(n, np.uint64(2**64 - 1))
    low[at] = grams
    place = np.arange(n, dtype=np.int64)
    grams, reach, width = low, 1, LENGTH - GRAM + 1

    def wider(by: int) -> None:
        nonlocal low, place
        take = low[by:] < low[:-by]  # strict: the leftmost wins
        low = np.concatenate([np.where(take, low[by:], low[:-by]), low[-by:]])
        place = np.concatenate([np.where(take, place[by:], place[:-by]), place[-by:]])

    while reach < width:
        step = min(reach, width - reach)
        wider(step)
        reach += step
    first = np.flatnonzero(words.text[: n - LENGTH + 1] == words.text[LENGTH - 1 :])
    if not len(first):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    owner = place[first]
    new = np.ones(len(first), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (first[1:] != first[:-1] + 1)
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(first)))
    start = first[begin]
    return start, size, grams[owner[begin]], range_hash(words.hashes, start, start + size + LENGTH - 1, "word")


@tidy
def _anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text"):
            words = Words(filled(part.column("text")))
            start, size, minimizer, span = owned_spans(words)
            text = words.text[start] if len(start) else start
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").take(pa.array(text)),
                    part.column("content").take(pa.array(text)),
                    pa.array((start - words.first[text]).astype(np.int32)),
                    pa.array(size.astype(np.int32)),
                    pa.array(minimizer.view(np.int64)),
                    pa.array(span.view(np.int64)),
                ],
                names=["doc_id", "content", "start", "size", "minimizer", "span"],
            )


@tidy
def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of the wanted spans: each span once a piece, its words joined by one space."""
    for batch in batches:
        for part in pieces(batch, "text"):
            words = Words(filled(part.column("text")), hashes=False)
            raw = words.data.tobytes()
            seen: dict[tuple[int, int], str] = {}
            for row, wanted in enumerate(part.column("wanted").to_pylist()):
                base = words.first[row]
                for w in wanted:
                    key = (w["minimizer"], w["span"])
                    if key not in seen:
                        a = base + w["start"]
                        b = a + w["size"] + LENGTH - 1
                        seen[key] = b" ".join([raw[x:y] for x, y in zip(words.starts[a:b].tolist(), words.stops[a:b].tolist(), strict=True)])
            keys = list(seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(list(seen.values()), pa.binary()).cast(pa.string())],
                names=["minimizer", "span", "words"],
            )


_RANGES = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list[tuple[int, int, int, str]]]]:
    """Rows, sorted by minimizer, as reference shards: lists of whole minimizers' rows."""
    shard, group, size = [], [], 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("minimizer", "span", "n", "words")), strict=True):
            if group and row[0] != group[-1][0]:
                shard.append(group)
                group = []
                if size >= SHARD_WORDS:
                    yield shard
                    shard, size = [], 0
            group.append(row)
            size += LENGTH + 14
    if group:
        yield [*shard, group]


@tidy
def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for shard in _shards(batches):
        automaton, ids, rows = SuffixAutomaton(), {}, []
        for group in shard:
            for minimizer, span, n, words in group:
                sequence = [ids.setdefault(w, len(ids)) for w in words.split(" ")]
                automaton.add(sequence, n)
                rows.append((minimizer, span, sequence))
        automaton.finish()
        found = [(m, s, r) for m, s, x in rows if (r := matched_ranges(automaton, x))]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([x[0] for x in found], pa.int64()),
                pa.array([x[1] for x in found], pa.int64()),
                pa.array([[{"start": a, "stop": b} for a, b in x[2]] for x in found], _RANGES),
            ],
            names=["minimizer", "span", "ranges"],
        )


def _divide(width: int):
    """Parts of spans: the windows whose owner gram stands at the offsets of one multiple of ``width``."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "words"):
                words, rows = Words(part.column("words")), part.num_rows
                size = words.counts - LENGTH + 1
                pivot = part.column("pivot").to_numpy().astype(np.int64)
                if (pivot < 0).any():  # the gram's first place, for spans that were not divided yet
                    at, grams = words.windows(GRAM)
                    mine = at[grams.view(np.int64) == part.column("owner").to_numpy()[words.text[at]]]
                    text, place = np.unique(words.text[mine], return_index=True)
                    pivot = pivot.copy()
                    pivot[text] = mine[place] - words.first[text]
                low, high = (pivot - size + 1) // width, pivot // width
                row = np.repeat(np.arange(rows), high - low + 1)
                node = np.arange(len(row)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1) - low, high - low + 1)
                start = pivot[row] - np.minimum(node * width + width - 1, pivot[row])
                stop = pivot[row] - np.maximum(node * width, (pivot - size + 1)[row]) + LENGTH
                # Shared by all windows of the node: between its first and its last offset.
                core = words.first[row] + pivot[row]
                shared = range_hash(words.hashes, core - node * width, core - np.minimum(node * width + width - 1, LENGTH - GRAM) + LENGTH, "word")
                base = words.first[row]
                whole = range_hash(words.hashes, base + start, base + stop, "word")
                raw = words.data.tobytes()
                cut = [raw[x:y] for x, y in zip(words.starts[base + start].tolist(), words.stops[base + stop - 1].tolist(), strict=True)]
                pick = pa.array(row)
                owner = mix(shared ^ mix((node * 64 + width).astype(np.uint64)))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c).take(pick) for c in ("minimizer", "span", "n")),
                        pa.array(owner.view(np.int64)),
                        pa.array(whole.view(np.int64)),
                        pa.array((part.column("at").to_numpy()[row] + start).astype(np.int32)),
                        pa.array((pivot[row] - start).astype(np.int32)),
                        pa.array((stop - start).astype(np.int32)),
                        pa.array(cut, pa.binary()).cast(pa.string()),
                    ],
                    names=["minimizer", "span", "n", "owner", "piece", "at", "pivot", "size", "words"],
                )

    return run


@tidy
def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text"):
            words = Words(filled(part.column("text")), hashes=False)
            n = len(words.starts)
            edge = np.zeros(n + 1, dtype=np.int64)
            lists = part.column("ranges")
            owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            base = words.first[owner]
            np.add.at(edge, base + flat.field("start").to_numpy(), 1)
            np.add.at(edge, base + flat.field("stop").to_numpy(), -1)
            gone = np.cumsum(edge)[:n] > 0
            kept = np.flatnonzero(~gone)
            # Bytes of kept words, and after each but a text's last kept one the gap byte behind it.
            data = words.data.copy()
            change = np.zeros(len(data) + 1, dtype=np.int8)
            change[words.starts[kept]] += 1
            change[words.stops[kept]] -= 1
            mask = np.cumsum(change, dtype=np.int8)[:-1] > 0
            more = kept[:-1][words.text[kept[1:]] == words.text[kept[:-1]]]
            mask[words.stops[more]] = True
            data[words.stops[more]] = 0x20
            total = np.concatenate([[0], np.cumsum(mask)])
            offsets = total[words.offsets].astype(np.int64)
            texts = pa.Array.from_buffers(pa.large_string(), len(lists), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[mask]))])
            removed = np.bincount(words.text[gone], minlength=len(lists)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(words.counts.astype(np.int64)), pa.array(removed), texts.cast(pa.string()), part.column("ranges")],
                names=["doc_id", "n_words", "n_removed", "kept_text", "ranges"],
            )


def remove_repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_text, ranges (words removed).

    Columns used: doc_id, text; others are ignored. Null and empty texts have no words. Repeated
    rows and rows that share a doc_id are texts of their own, so an exact copy of 35 words or more
    empties both. A null doc_id stays null. An empty table gives no rows.
    """
    store = Store(spark, "substring")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("content"), "text")
    schema = "doc_id long, content long, start int, size int, minimizer long, span long"
    anchors = store.put("anchors", docs.mapInArrow(_anchor, schema))
    twice = anchors.groupBy("minimizer").agg(F.count(F.lit(1)).alias("n"), F.min("span").alias("low"), F.max("span").alias("high")).filter("n > 1")
    twice = store.put("twice", twice.select("minimizer", (F.col("low") == F.col("high")).alias("uniform")))
    spans = store.put("spans", anchors.join(twice, "minimizer"))
    store.drop("anchors")

    mixed = spans.filter("not uniform")
    # One place of each distinct span is read; each text is visited once for all spans it serves.
    place = mixed.groupBy("minimizer", "span").agg(F.min(F.struct("doc_id", "content", "start", "size")).alias("p"), F.count(F.lit(1)).alias("n"))
    place = store.put("places", place.select("minimizer", "span", "n", "p.*"))
    wanted = place.groupBy(F.col("doc_id").alias("at_doc"), F.col("content").alias("at_content"))
    wanted = wanted.agg(F.collect_list(F.struct("minimizer", "span", "start", "size")).alias("wanted"))
    here = F.col("doc_id").eqNullSafe(F.col("at_doc")) & (F.col("content") == F.col("at_content"))
    cut = docs.join(wanted, here).select("text", "wanted").mapInArrow(_cut, "minimizer long, span long, words string")
    weights = place.select("minimizer", "span", "n")
    texts = store.put("texts", cut.dropDuplicates(["minimizer", "span"]).join(weights, ["minimizer", "span"]))

    found = "minimizer long, span long, ranges array<struct<start:int,stop:int>>"

    def match(rows: DataFrame) -> DataFrame:
        dealt = rows.select("minimizer", "span", "n", "words").repartition("minimizer").sortWithinPartitions("minimizer")
        return dealt.mapInArrow(_match, found)

    crowd = texts.groupBy("minimizer").agg(F.count(F.lit(1)).alias("spans")).filter(F.col("spans") > CROWD).select("minimizer")
    crowd = store.put("crowd", crowd)
    covered = [store.put("covered", match(texts.join(crowd, "minimizer", "left_anti")))]
    rest, width = crowd, 1 << (LENGTH - GRAM).bit_length()
    parts = texts.join(crowd, "minimizer", "left_semi").select("minimizer", "span", "n", F.col("minimizer").alias("owner"), F.lit(0).alias("at"), F.lit(-1).alias("pivot"), "words")
    schema = "minimizer long, span long, n long, owner long, piece long, at int, pivot int, size int, words string"
    while width > 1 and not rest.isEmpty():
        width //= 2
        parts = store.put(f"parts{width}", parts.select("minimizer", "span", "n", "owner", "at", "pivot", "words").mapInArrow(_divide(width), schema))
        merged = parts.groupBy("owner", "piece").agg(F.sum("n").alias("n"), F.any_value("words").alias("words"))
        merged = store.put(f"merged{width}", merged)
        owners = merged.groupBy("owner").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("pieces")).filter("total > 1")
        owners = store.put(f"owners{width}", owners.select("owner", "pieces"))
        even = parts.join(owners.filter("pieces = 1"), "owner", "left_semi")
        even = even.select("minimizer", "span", F.array(F.struct(F.col("at").alias("start"), (F.col("at") + F.col("size")).alias("stop"))).alias("ranges"))
        few = merged.join(owners.filter(F.col("pieces").between(2, CROWD)), "owner", "left_semi")
        few = match(few.withColumnsRenamed({"owner": "minimizer", "piece": "span"})).withColumnsRenamed({"minimizer": "owner", "span": "piece"})
        few = parts.join(few, ["owner", "piece"]).select("minimizer", "span", F.expr("transform(ranges, r -> struct(r.start + at as start, r.stop + at as stop))").alias("ranges"))
        covered.append(store.put(f"covered{width}", even.unionByName(few)))
        rest = owners.filter(F.col("pieces") > CROWD)
        parts = parts.join(rest, "owner", "left_semi")
    covered = reduce(DataFrame.unionByName, covered)

    whole = F.array(F.struct(F.lit(0).alias("start"), (F.col("size") + LENGTH - 1).alias("stop")))
    here = spans.filter("uniform").select("doc_id", "content", "start", whole.alias("ranges"))
    here = here.unionByName(mixed.join(covered, ["minimizer", "span"]).select("doc_id", "content", "start", "ranges"))
    flat = here.select("doc_id", "content", "start", F.explode("ranges").alias("r"))
    flat = flat.select("doc_id", "content", F.struct((F.col("start") + F.col("r.start")).alias("start"), (F.col("start") + F.col("r.stop")).alias("stop")).alias("r"))
    lists = flat.groupBy(F.col("doc_id").alias("at_doc"), F.col("content").alias("at_content")).agg(F.sort_array(F.collect_set("r")).alias("ranges"))
    lists = store.put("lists", lists)
    store.keep("lists")
    same = F.col("doc_id").eqNullSafe(F.col("at_doc")) & (F.col("content") == F.col("at_content"))
    none = F.expr("cast(array() as array<struct<start:int,stop:int>>)")
    ready = docs.join(lists, same, "left").select("doc_id", "text", F.coalesce("ranges", none).alias("ranges"))
    return ready.mapInArrow(_remove, "doc_id long, n_words long, n_removed long, kept_text string, ranges array<struct<start:int,stop:int>>")
