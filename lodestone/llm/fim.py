"""Fill-in-middle: texts cut in three by units, put together in another order with sentinels, and put back.

A text is a rope: a balanced tree whose leaves hold a few thousand characters, cut between units, and whose nodes cache
how many units and code points lie below. Cutting at a unit or a character goes down one path; only a leaf is searched.

A unit is white space and the word after it, or the white space at the end of a text. Rows with null text are as with
empty text: no units, plain. A null doc_id draws as an empty number. Each row is changed by itself, so repeated rows come
out alike, and other columns, whatever their names, are left aside. A unit is never cut, so a very long word is one leaf.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import tidy
from lodestone.session import ensure_importable

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
LEAF = 4096  # code points, or the unit that goes beyond

_UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
_BORDER = re.compile(r"[^\x20\x09-\x0D](?=[\x20\x09-\x0D])")


@dataclass(frozen=True, slots=True)
class Rope:
    units: int
    chars: int
    height: int = 0
    text: str = ""
    left: Rope | None = None
    right: Rope | None = None

    @staticmethod
    def leaf(text: str) -> Rope:
        return Rope(len(_UNIT.findall(text)), len(text), 0, text)

    @staticmethod
    def mark(text: str) -> Rope:
        """A leaf that counts no unit."""
        return Rope(0, len(text), 0, text)

    @staticmethod
    def of(text: str) -> Rope:
        leaves, at = [], 0
        while at < len(text):
            border = _BORDER.search(text, at + LEAF - 1) if at + LEAF < len(text) else None
            end = border.end() if border else len(text)
            leaves.append(Rope.leaf(text[at:end]))
            at = end
        while len(leaves) > 1:
            leaves = [Rope.node(*leaves[i : i + 2]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
        return leaves[0] if leaves else Rope.leaf("")

    @staticmethod
    def node(left: Rope, right: Rope) -> Rope:
        return Rope(left.units + right.units, left.chars + right.chars, 1 + max(left.height, right.height), "", left, right)

    def __add__(self, other: Rope) -> Rope:
        """Both, one after the other; subtrees are hung so that heights differ by one at most."""
        if not self.chars or not other.chars:
            return self if self.chars else other
        if self.height > other.height + 1:
            return _level(self.left, self.right + other)
        if other.height > self.height + 1:
            return _level(self + other.left, other.right)
        return Rope.node(self, other)

    def cut_at_unit(self, k: int) -> tuple[Rope, Rope]:
        """The first ``k`` units, and the rest."""
        if k <= 0 or k >= self.units:
            return (Rope.leaf(""), self) if k <= 0 else (self, Rope.leaf(""))
        if self.left is None:
            at = next(m.end() for i, m in enumerate(_UNIT.finditer(self.text), 1) if i == k)
            return Rope(k, at, 0, self.text[:at]), Rope(self.units - k, self.chars - at, 0, self.text[at:])
        if k <= self.left.units:
            a, b = self.left.cut_at_unit(k)
            return a, b + self.right
        a, b = self.right.cut_at_unit(k - self.left.units)
        return self.left + a, b

    def cut_at_char(self, k: int) -> tuple[Rope, Rope]:
        """The first ``k`` code points, and the rest."""
        if k <= 0 or k >= self.chars:
            return (Rope.leaf(""), self) if k <= 0 else (self, Rope.leaf(""))
        if self.left is None:
            return Rope.leaf(self.text[:k]), Rope.leaf(self.text[k:])
        if k <= self.left.chars:
            a, b = self.left.cut_at_char(k)
            return a, b + self.right
        a, b = self.right.cut_at_char(k - self.left.chars)
        return self.left + a, b

    def __str__(self) -> str:
        out, open_ = [], [self]
        while open_:
            x = open_.pop()
            if x.left is None:
                out.append(x.text)
            else:
                open_ += [x.right, x.left]
        return "".join(out)


def _level(left: Rope, right: Rope) -> Rope:
    """A node of two subtrees whose heights differ by two at most, turned to differ by one."""
    if left.height > right.height + 1:
        if left.left.height >= left.right.height:
            return Rope.node(left.left, Rope.node(left.right, right))
        return Rope.node(Rope.node(left.left, left.right.left), Rope.node(left.right.right, right))
    if right.height > left.height + 1:
        if right.right.height >= right.left.height:
            return Rope.node(Rope.node(left, right.left), right.right)
        return Rope.node(Rope.node(left, right.left.left), Rope.node(right.left.right, right.right))
    return Rope.node(left, right)


def drawn(seed: int, doc_id: int | None) -> list[int]:
    """Four numbers of 32 bits for a document."""
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digits[i : i + 8], 16) for i in range(0, 32, 8)]


def rearranged(text: str, draws: list[int], percent: int, spm_percent: int) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and middle (None if plain), and the output."""
    rope = Rope.of(text)
    n, (h1, h2, h3, h4) = rope.units, draws
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= percent:
        return n, PLAIN, None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    head, suffix = rope.cut_at_unit(high)
    prefix, middle = head.cut_at_unit(low)
    p, s, m = map(Rope.mark, (PREFIX, SUFFIX, MIDDLE))
    form = SPM if h4 % 100 < spm_percent else PSM
    out = s + suffix + p + prefix + m + middle if form == SPM else p + prefix + s + suffix + m + middle
    return n, form, prefix.chars, middle.chars, str(out)


def put_back(output: str, form: str) -> str:
    """The text that an output was made of. Sentinels are where they come first: no part holds one, and none can begin in
    a part and end in a sentinel."""
    if form == PLAIN:
        return output
    first, second = (SUFFIX, PREFIX) if form == SPM else (PREFIX, SUFFIX)
    b = output.index(second, len(first))
    c = output.index(MIDDLE, b + len(second))
    rest, middle = Rope.of(output).cut_at_char(c)
    rest, two = rest.cut_at_char(b)
    one = rest.cut_at_char(len(first))[1]
    two, middle = two.cut_at_char(len(second))[1], middle.cut_at_char(len(MIDDLE))[1]
    prefix, suffix = (two, one) if form == SPM else (one, two)
    return str(prefix + middle + suffix)


def transformed(docs: DataFrame, percent: int = 50, spm_percent: int = 80, seed: int = 42) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output, for every row."""
    ensure_importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            made = [rearranged(x.as_py() or "", drawn(seed, i), percent, spm_percent) for i, x in zip(ids, batch.column("text"), strict=True)]
            n, form, p, m, out = zip(*made, strict=True) if made else ((),) * 5
            arrays = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(p, pa.int64()), pa.array(m, pa.int64()), pa.array(out, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(rows: DataFrame) -> DataFrame:
    """``rows`` of ``transformed`` with ``restored``, the text, from output and form alone."""
    ensure_importable(rows.sparkSession)
    names = [*rows.columns, "restored"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            back = pa.array([put_back(x.as_py(), f) for x, f in zip(batch.column("output"), batch.column("form").to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, back], names)

    return rows.mapInArrow(tidy(run), f"{rows.schema.toDDL()}, restored string")
