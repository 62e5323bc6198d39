"""Fill-in-middle transformation by run-length class encoding.

A text is stored as its maximal runs of one character class (white space or not): where each run starts, how many units
end before it and how many characters a unit of it has. A cut after u units is then found by a binary search for the
run that holds unit u, and its place is arithmetic: start + (u - units before) * width. No list of units is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, raw_bytes, slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNITS = ("token", "character")


class Runs:
    """The runs of all texts of an Arrow array. starts: first byte of each; chars: code points before each byte; before:
    units that end before each run, over all texts; width: characters of a unit of the run (0: it has no unit)."""

    def __init__(self, texts: pa.Array, units: str = "token"):
        self.data, self.off = raw_bytes(texts)
        n = len(self.data)
        white = SPACE[self.data]
        new = np.ones(n, bool)
        new[1:] = white[1:] != white[:-1]
        new[self.off[(self.off > 0) & (self.off < n)]] = True
        self.starts = np.flatnonzero(new)
        self.chars = np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80)])
        ends = np.append(self.starts[1:], n)
        size = self.chars[ends] - self.chars[self.starts]
        if units == "token":  # white space belongs to the token after it; at the end of a text it is one
            count = (~white[self.starts] | np.isin(ends, self.off)).astype(np.int64)
            self.width = size * count
        else:
            count, self.width = size, np.ones(len(size), np.int64)
        self.before = np.concatenate([[0], np.cumsum(count)])
        #: First run of each text, and one more.
        self.first = np.searchsorted(self.starts, self.off)

    def count(self) -> np.ndarray:
        """Units of each text."""
        return np.diff(self.before[self.first])

    def cuts(self, units: np.ndarray) -> np.ndarray:
        """The number of characters before the end of that many units of each text, from the text's start."""
        base = self.before[self.first[:-1]]
        run = np.searchsorted(self.before, base + units, "left") - 1  # the run that the last unit is of
        some = units > 0
        at = np.zeros(len(units), np.int64)
        run = run[some]
        at[some] = self.chars[self.starts[run]] + (base[some] + units[some] - self.before[run]) * self.width[run] - self.chars[self.off[:-1][some]]
        return at

    def byte_of(self, chars: np.ndarray) -> np.ndarray:
        """The byte, among all texts', after so many characters of each text."""
        return np.searchsorted(self.chars, self.chars[self.off[:-1]] + chars, "right") - 1


def draws(doc_id: str, seed: int) -> list[Column]:
    """Four unsigned numbers of 32 bits for a document; a null id counts as an empty one."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, fim_rate: int = 50, spm_rate: int = 80, seed: int = 42, units: str = "token") -> DataFrame:
    """docs with n (units of the text), form (plain, psm or spm), prefix_chars, middle_chars (code points; null if plain)
    and output (the transformed text) added, over columns of those names.

    fim_rate: percent of documents that are cut; spm_rate: percent of those whose suffix comes first; units: "token"
    (words with the white space before them, and white space at the end) or "character". Null and empty texts, and
    texts that hold one of the three marks, stay plain; null gives an empty output. All else depends on doc_id alone, so
    repeated rows, and other texts of the same id, are drawn alike. A text is cut anywhere, whatever its length. An empty
    table gives an empty result.
    """
    if units not in UNITS:
        raise ValueError(f"units must be one of {UNITS}")
    made = ("n", "form", "prefix_chars", "middle_chars", "output")
    names = [c for c in docs.columns if c not in made]
    at, k = names.index("text"), len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, at):
            r = Runs(b.column(at), units)
            n = r.count()
            h = [b.column(k + i).to_numpy().astype(np.int64) for i in range(4)]
            one, two = h[0] % (n + 1), h[1] % (n + 1)
            low, high = r.cuts(np.minimum(one, two)), r.cuts(np.maximum(one, two))
            first, last = r.byte_of(low), r.byte_of(high)
            whole = r.data.tobytes()
            form, out = [], []
            for i, (s, e) in enumerate(zip(r.off[:-1], r.off[1:], strict=True)):
                text = whole[s:e]
                if not text or h[2][i] % 100 >= fim_rate or any(m.encode() in text for m in (PREFIX, SUFFIX, MIDDLE)):
                    form.append("plain")
                    out.append(text)
                    continue
                prefix, middle, suffix = whole[s : first[i]], whole[first[i] : last[i]], whole[last[i] : e]
                form.append("spm" if h[3][i] % 100 < spm_rate else "psm")
                parts = {"p": PREFIX.encode() + prefix, "s": SUFFIX.encode() + suffix, "m": MIDDLE.encode() + middle}
                out.append(b"".join(parts[x] for x in form[-1]))
            plain = np.array([f == "plain" for f in form], bool)
            columns = [pa.array(n), pa.array(form, pa.string()), pa.array(low, mask=plain), pa.array(high - low, mask=plain), pa.array(out, pa.binary()).cast(pa.string())]
            yield pa.record_batch([*b.columns[:k], *columns], names=[*names, *made])

    schema = T.StructType(list(docs.select(*names).schema.fields)).add("n", "long").add("form", "string").add("prefix_chars", "long").add("middle_chars", "long").add("output", "string")
    return docs.select(*names, *[c.alias(f"__h{i}") for i, c in enumerate(draws("doc_id", seed))]).mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of transform() was made of. The marks are found again without doubt: the text holds none,
    and no mark begins with another's end."""

    def parted(first: str, second: str, third: str) -> tuple[Column, Column, Column]:
        body = F.substring(output, len(first) + 1, F.length(output))
        one = F.substring_index(body, second, 1)
        rest = F.substring(body, F.length(one) + F.lit(len(second) + 1), F.length(body))
        two = F.substring_index(rest, third, 1)
        return one, two, F.substring(rest, F.length(two) + F.lit(len(third) + 1), F.length(rest))

    prefix, suffix, middle = parted(PREFIX, SUFFIX, MIDDLE)
    first, second, last = parted(SUFFIX, PREFIX, MIDDLE)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(second, last, first)).otherwise(output)
