"""Finding passages of a benchmark in a corpus, up to a few edits.

Each test item is split into one piece more than its error budget, so a passage within the budget holds at least one
piece unchanged. All pieces are searched at once with an Aho-Corasick automaton over whole texts; where a piece hits, the
item's surroundings are verified with Myers' bit-parallel approximate matching.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import cut, fresh, row_key, ship, small

#: Characters of test items that one automaton holds (some 100 bytes each); more items go in further blocks.
BLOCK_CHARS = 1_000_000
#: Automata that a worker keeps, and characters of texts that meet one before the next.
MATCHERS, BATCH_CHARS = 2, 4_000_000


def normalise(text: str | None) -> str:
    """Lower case, with single blanks."""
    return " ".join((text or "").lower().split())


def budget(item: str, rate: float) -> int:
    """Edits that are allowed in an item: its share, rounded down."""
    return int(len(item) * rate)


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """The item in ``edits + 1`` pieces with their starts."""
    cuts = [len(item) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def best_match(pattern: str, text: str) -> tuple[int, int]:
    """Least edits of ``pattern`` against any part of ``text``, and the end of the first such part (Myers 1999)."""
    where: dict[str, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    mask, top = (1 << len(pattern)) - 1, len(pattern) - 1
    up, down, score = mask, 0, len(pattern)
    best, end = score, 0
    for j, c in enumerate(text, 1):
        eq = where.get(c, 0)
        same = (((eq & up) + up) ^ up) | eq | down
        right, left = down | ~(same | up) & mask, up & same
        score += (right >> top & 1) - (left >> top & 1)
        right, left = right << 1, left << 1  # a match may start anywhere, at no cost
        up, down = (left | ~(same | right)) & mask, right & same & mask
        if score < best:
            best, end = score, j
    return best, end


class Matcher:
    """Searches texts for a block of items."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items = [(item_id, text, budget(text, rate)) for item_id, text in items]
        places: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text, edits) in enumerate(self.items):
            for at, piece in pieces(text, edits):
                places.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, found in places.items():
            self.automaton.add_word(piece, (len(piece), found))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item, least edits, occurrences) of each item in a normalised text; occurrences of an item don't overlap."""
        out: dict[int, tuple[int, int]] = {}
        done: dict[int, int] = {}  # up to where occurrences of an item are counted
        tried: set[tuple[int, int]] = set()
        for last, (size, places) in self.automaton.iter(text):
            for k, at in places:
                start = last - size + 1 - at  # below 0 in a text that lacks an item's start
                if (k, start) in tried:
                    continue
                tried.add((k, start))
                before, n = out.get(k, (None, 0))
                new = start >= done.get(k, start)
                if before == 0 and not new:
                    continue
                _, item, edits = self.items[k]
                if start >= 0 and text.startswith(item, start):
                    least, end = 0, start + len(item)
                elif edits:
                    lo = max(0, start - edits)
                    least, end = best_match(item, text[lo : start + len(item) + edits])
                    end += lo
                else:
                    continue
                if least <= edits:
                    out[k] = (least if before is None else min(least, before), n + new)
                    if new:
                        done[k] = end - edits
        return [(self.items[k][0], least, n) for k, (least, n) in sorted(out.items())]


def _blocks(benchmark: DataFrame, item_col: str, item_text_col: str, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items, normalised, in blocks of about ``block_chars`` characters; one block is held at a time."""
    block, held = [], 0
    for row in benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).cast("string").alias("t")).toLocalIterator():
        if item := normalise(row["t"]):
            if held + len(item) > block_chars and block:
                yield block
                block, held = [], 0
            block.append((row["i"], item))
            held += len(item)
    if block:
        yield block


def _search(texts: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, rate: float, block_chars: int) -> DataFrame:
    """``item_id, edits, occurrences`` for each text and item, after the columns (longs) that stand before ``text``."""
    spark = texts.sparkSession
    ship(spark)
    blocks = [spark.sparkContext.broadcast(block) for block in _blocks(benchmark, item_col, item_text_col, block_chars)]
    names = [c for c in texts.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = lru_cache(MATCHERS)(lambda k: Matcher(blocks[k].value, rate))
        turn = 0
        for batch in batches:
            kept, found, column, lo = [], [], batch.column("text"), 0
            while lo < batch.num_rows:
                # whole texts of some BATCH_CHARS meet block by block, in one scan of the corpus
                texts, held = [], 0
                while lo + len(texts) < batch.num_rows and (not texts or len(blocks) > 1 and held < BATCH_CHARS):
                    texts.append(normalise(column[lo + len(texts)].as_py()))
                    held += len(texts[-1])
                # to and fro, so that the last automaton of a turn is the first of the next
                for k in range(len(blocks))[:: -1 if turn % 2 else 1]:
                    for at, text in enumerate(texts, lo):
                        leaks = matcher(k).find(text)
                        kept += [at] * len(leaks)
                        found += leaks
                lo, turn = lo + len(texts), turn + 1
            kinds = (pa.int64(), pa.int32(), pa.int32())
            columns = zip(*found, strict=True) if found else [[]] * 3
            at = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in names), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], [*names, "item_id", "edits", "occurrences"])

    return texts.mapInArrow(run, ", ".join([*(f"{c} long" for c in names), "item_id long", "edits int", "occurrences int"]))


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = 0.08, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, item_id, edits, occurrences`` for each row of ``docs`` and item that it holds within the item's budget.

    The budget of an item is ``rate`` of its characters, rounded down. Case and white space are levelled on both sides.
    Items that are null or blank match nothing; items whose budget is 0 match only unchanged; equal items are all
    reported. Null and empty texts hold nothing; rows that repeat an id, and rows with a null id, are searched row by row;
    other columns are ignored; an empty table or benchmark gives an empty result.

    The benchmark is a query set. It goes to the workers in blocks of ``block_chars``, of which the driver holds one at a
    time; all blocks are matched in one scan of the texts, in batches, and a worker keeps ``MATCHERS`` automata at a
    time. There is no shuffle of texts.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return _search(texts, benchmark, item_col, item_text_col, rate, block_chars)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = 0.08, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` without the rows that hold a passage of the benchmark within its item's budget; all their columns stay.

    Each row is judged by its own text: of rows that repeat an id only those with a passage go, and rows with a null id
    go as others do. Rows with a null, empty or blank text stay. An empty table gives an empty result, an empty benchmark
    drops nothing.
    """
    key = row_key(docs)
    texts = docs.select(key[0].alias("r1"), key[1].alias("r2"), F.col(text_col).cast("string").alias("text"))
    names = fresh(docs, "r1", "r2")
    leaked = cut(_search(texts, benchmark, item_col, item_text_col, rate, block_chars).select("r1", "r2").distinct()).toDF(*names)
    return docs.join(small(leaked), [k == F.col(n) for k, n in zip(key, names, strict=True)], "left_anti")
