"""Fill-in-the-middle: a text is cut in three and its parts put in another order.

Units of a text are [A-Za-z]+ runs and single other code points. Cuts are wanted at ranks of units, but
a text is never split into units: code points outside ASCII are stood for by one ASCII character each, and
one Aho-Corasick automaton scans for events: a letter next to a character that is none (either
way round), and sentinels. Between two events all is of one class, so a gap of letters is one unit and any other gap has as
many units as code points; running sums over the gaps find the place of a rank by bisection.

Where to cut is drawn from SHA-256 of "1:" and the document's id. Form `plain` is the text as it is (empty
texts, texts that hold a sentinel, and 10 in 100 of the others); `psm` is <P>prefix<S>suffix<M>middle, `spm` is
<S>suffix<P>prefix<M>middle. No sentinel can arise where parts meet, as each begins with its only "<" and
ends with its only ">", so `restored` finds the parts again.

Null text counts as empty; a null id draws as the empty string. Every input row gives one row, repeated ones too; an empty
table gives none. A very long text is scanned whole: 8 bytes for each event, two events a word. Other columns, whatever
their names, are left out of `transform`, or kept whole in one struct.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import StructField, StructType

from lexroute.llm.sparkops import boxed, quoted

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_SHARE, SPM_SHARE = 10, 20
#: Characters of output after which a batch is handed on.
BATCH_CHARS = 1 << 22
KINDS = {"doc_id": pa.int64(), "n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.string()}

_LETTERS = [chr(c) for c in range(128) if chr(c).isalpha()]
_OTHERS = [chr(c) for c in range(128) if not chr(c).isalpha()]


def automaton() -> ahocorasick.Automaton:
    """Events end at a change of class with value 0, or at a sentinel's last character with value 1."""
    found = ahocorasick.Automaton()
    for a in _LETTERS:
        for b in _OTHERS:
            found.add_word(a + b, 0)
            found.add_word(b + a, 0)
    for s in (PREFIX, SUFFIX, MIDDLE):
        found.add_word(s, 1)
    found.make_automaton()
    return found


class Units:
    """Ranks of units in a text, from its sparse events."""

    def __init__(self, text: str, events: ahocorasick.Automaton):
        one_each = text if text.isascii() else text.encode("ascii", "replace").decode("ascii")
        seen = np.fromiter((end << 1 | kind for end, kind in events.iter(one_each)), np.int64)
        self.has_sentinel = bool((seen & 1).any())
        changes = seen[seen & 1 == 0] >> 1
        self.edges = np.concatenate([[0], changes, [len(text)]]) if text else np.zeros(1, np.int64)
        gaps = np.diff(self.edges)
        self.letters = np.arange(len(gaps)) % 2 == (0 if text and one_each[0].isalpha() else 1)
        self.upto = np.concatenate([[0], np.cumsum(np.where(self.letters, 1, gaps))])

    def __len__(self) -> int:
        return int(self.upto[-1])

    def end_of(self, rank: int) -> int:
        """Code points up to the end of so many units."""
        if not rank:
            return 0
        k = int(np.searchsorted(self.upto, rank)) - 1
        return int(self.edges[k + 1] if self.letters[k] else self.edges[k] + rank - self.upto[k])


def draws(id: int | None) -> list[int]:
    h = hashlib.sha256(f"1:{'' if id is None else id}".encode()).hexdigest()
    return [int(h[i : i + 8], 16) for i in range(0, 32, 8)]


def cut(text: str, id: int | None, events: ahocorasick.Automaton) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and middle (None if plain), output."""
    units = Units(text, events)
    n = len(units)
    h1, h2, h3, h4 = draws(id)
    if not text or units.has_sentinel or h3 % 100 >= 100 - PLAIN_SHARE:
        return n, "plain", None, None, text
    a, b = (units.end_of(r) for r in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < SPM_SHARE:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def transform(docs: DataFrame, text: str = "text", id: str = "doc_id", keep_columns: bool = False) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row; with keep_columns, all columns of docs too, as the struct `row`."""

    def run(batches):
        events = automaton()
        for batch in batches:
            rows, size, first = [], 0, 0
            for k, (i, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
                rows.append((i, *cut(t.as_py() or "", i, events)))
                size += len(rows[-1][-1])
                if size > BATCH_CHARS or k + 1 == batch.num_rows:
                    made = [pa.array(c, kind) for c, kind in zip(zip(*rows), KINDS.values())]
                    boxes = [batch.column(2).slice(first, len(rows))] if keep_columns else []
                    yield pa.RecordBatch.from_arrays(made + boxes, [*KINDS, *["row"] * keep_columns])
                    rows, size, first = [], 0, k + 1

    columns = [quoted(id).cast("long").alias("doc_id"), quoted(text).cast("string").alias("text")]
    source = docs.select(*columns, *[boxed(docs).alias("row")] * keep_columns)
    out = StructType([StructField(c, from_arrow_type(kind)) for c, kind in KINDS.items()])
    return source.mapInArrow(run, out.add("row", source.schema["row"].dataType) if keep_columns else out)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of that form was made of: parts lie between its own sentinel at the start and the first of each next kind."""
    w = len(PREFIX)
    second = F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX))
    a = F.call_function("locate", second, output, F.lit(w + 1))
    b = F.call_function("locate", F.lit(MIDDLE), output, a + w)
    one, two, three = F.substring(output, F.lit(w + 1), a - w - 1), F.substring(output, a + w, b - a - w), F.substring(output, b + w, F.length(output))
    return F.when(form == "psm", F.concat(one, three, two)).when(form == "spm", F.concat(two, three, one)).otherwise(output)
