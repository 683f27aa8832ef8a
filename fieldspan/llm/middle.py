"""Fill-in-middle: texts cut in three and put in another order, and put back.

The units to cut between come from the tokenizers library's Split pre-tokenizer with a
regular expression whose matches stay isolated. It carries code-point offsets for each
match: the length of the offset array is the number of units, and the offsets at two
ranks are where the text is cut. No tokenizer is trained; the one around the splitter
knows no words.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Any one code point.
POINT = r"[\s\S]"
#: A word with the space after it, of at most 64 code points, and how many of these a
#: task remembers: where units are code points, equal runs have as many units.
RUN = r"\S{0,63}\s|\S{1,64}"
KNOWN = 1 << 17
#: What stands before prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")


class Offsets:
    """Offsets of the units of a text, which are the matches of ``unit`` and what is between."""

    def __init__(self, unit: str = POINT):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        self._tokenizer = Tokenizer(models.WordLevel({"": 0}, unk_token=""))
        self._tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(unit), "isolated")
        # single code points may be split anywhere first, other matches may not
        self._runs = re.compile(RUN).findall if unit == POINT else lambda text: [text] if text else []
        self._known: dict[str, int] = {}

    def _sizes(self, runs: list[str]) -> list[int]:
        """Number of units of each run, each distinct one split once."""
        fresh = [r for r in dict.fromkeys(runs) if r not in self._known]
        if len(self._known) + len(fresh) > KNOWN:
            self._known.clear()
            fresh = list(dict.fromkeys(runs))
        for lo in range(0, len(fresh), 1000):
            part = fresh[lo : lo + 1000]
            self._known.update(zip(part, map(len, self._tokenizer.encode_batch_fast(part, add_special_tokens=False)), strict=True))
        return list(map(self._known.__getitem__, runs))

    def cut(self, text: str, *draws: int) -> tuple[int, list[int]]:
        """The number n of units and, for each draw, the code points before unit draw % (n + 1)."""
        runs = self._runs(text)
        before = [0, *accumulate(self._sizes(runs))]
        n, out = before[-1], []
        for rank in (d % (n + 1) for d in draws):
            if rank == n:
                out.append(len(text))
                continue
            i = bisect_right(before, rank) - 1
            offsets = self._tokenizer.encode(runs[i], add_special_tokens=False).offsets
            out.append(sum(map(len, runs[:i])) + offsets[rank - before[i]][0])
        return n, out


def draws(id_col: Column, seed: int, n: int = 4) -> list[Column]:
    """``n`` unsigned 32-bit integers (8 at most) from the SHA-256 of seed and id."""
    hexed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(hexed, 8 * i + 1, 8), 16, 10).cast("long") for i in range(n)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain_from: int = 90, spm_below: int = 20, markers: Sequence[str] = MARKERS, unit: str = POINT) -> DataFrame:
    """``docs`` plus fim_units, fim_form, fim_prefix, fim_middle, fim_suffix and fim_text.

    A draw by the id cuts the text before two of its units. ``fim_form`` is ``plain`` for
    texts that are empty or hold a marker, and where the third draw modulo 100 is
    ``plain_from`` or more; else ``spm`` where the fourth modulo 100 is below
    ``spm_below``, else ``psm``. ``fim_text`` is the text itself, or the three parts
    behind their markers: prefix, suffix, middle, or for spm suffix, prefix, middle. The
    parts of a plain text are NULL. Null texts count as empty, a null id as an empty one;
    rows pass one by one, and columns of ``docs`` with the new names are replaced.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf("n long, a long, b long")
    def cuts(text: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        offsets = Offsets(unit)
        for t, x, y in text:
            out = []
            for args in zip(t, x, y, strict=True):
                n, (a, b) = offsets.cut(*args)
                out.append((n, min(a, b), max(a, b)))
            yield pd.DataFrame(out, columns=["n", "a", "b"])

    h = draws(F.col(id_col), seed)
    p, s, m = (F.lit(x) for x in markers)
    text = F.coalesce(F.col(text_col), F.lit(""))
    marked = text.contains(markers[0]) | text.contains(markers[1]) | text.contains(markers[2])
    form = F.when((text == "") | marked | (h[2] % 100 >= plain_from), "plain").when(h[3] % 100 < spm_below, "spm").otherwise("psm")
    df = docs.withColumns({"fim_cut_": cuts(text, h[0], h[1]), "fim_form": form})
    a, b = F.col("fim_cut_.a").cast("int"), F.col("fim_cut_.b").cast("int")
    part = lambda x: F.when(F.col("fim_form") != "plain", x)
    df = df.withColumns({"fim_units": F.col("fim_cut_.n"), "fim_prefix": part(F.substr(text, F.lit(1), a)), "fim_middle": part(F.substr(text, a + 1, b - a)), "fim_suffix": part(F.substr(text, b + 1))})
    psm = F.concat(p, "fim_prefix", s, "fim_suffix", m, "fim_middle")
    spm = F.concat(s, "fim_suffix", p, "fim_prefix", m, "fim_middle")
    return df.withColumn("fim_text", F.when(F.col("fim_form") == "psm", psm).when(F.col("fim_form") == "spm", spm).otherwise(text)).drop("fim_cut_")


def restored(text: Column, form: Column, markers: Sequence[str] = MARKERS) -> Column:
    """The text before ``fill_in_middle``, from its output and form alone.

    No marker stands in the parts of a text that was rearranged, nor can one arise where
    a part meets a marker, so that each is found where it was put.
    """
    parts = F.split(text, "|".join(map(re.escape, markers)), -1)
    at = lambda i: F.element_at(parts, i)
    return F.when(form == "psm", F.concat(at(2), at(4), at(3))).when(form == "spm", F.concat(at(3), at(4), at(2))).otherwise(text)
