"""Quality rules as a short-circuit cascade, in DataFrame functions only."""

from __future__ import annotations

import re
import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Rows at most that cost and selectivity of the rules are estimated on, how often each
#: is timed, and the seconds below which times are noise.
SAMPLE_ROWS, TIMES, NOISE = 500, 2, 0.002

#: Repeated windows up to which a linear search beats a sort of all windows.
FEW = 32


@dataclass(frozen=True)
class Rule:
    """Rejects a document if ``reject`` (SQL over the measures) holds; ``needs``
    names the measures it reads, which are computed only as far as it is reached."""

    name: str
    needs: tuple[str, ...]
    reject: str


# Common words of the four languages.
STOP_WORDS = (
    "a an and are as at be by for from have he in is it not of on or that the this to was with you "
    "der die das und ist nicht ein eine zu mit von den auf f\u00fcr im "
    "le la les un une et est de des du en que qui pas pour dans "
    "el los las y es una por con para del se no"
).split(" ")
_STOP = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
_BLANK = r"[\\x20\\x09\\x0B-\\x0D]*"

#: Measures as SQL over ``q_text`` (never null) and ``q_words`` (its words).
MEASURES = {
    "n_words": "cast(size(q_words) as bigint)",
    "word_chars": r"cast(length(q_text) - regexp_count(q_text, '[\\x20\\x09-\\x0D]') as bigint)",
    "n_symbols": r"cast(regexp_count(q_text, '[#*$%&|<>]') as bigint)",
    "n_lines": r"cast(regexp_count(q_text, '[^\\n\\x20\\x09-\\x0D][^\\n]*') as bigint)",
    "n_dup_lines": r"""transform(array(filter(split(q_text, '\\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')),
        ls -> cast(size(ls) - size(array_distinct(ls)) as bigint))[0]""",
    "n_repeat_words": f"""case when size(q_words) < 4 then 0L else transform(array(
        transform(sequence(0, greatest(size(q_words) - 3, 0)), i -> xxhash64(q_words[i], q_words[i + 1], q_words[i + 2]))), h ->
        transform(array(sort_array(h)), s ->
        transform(array(array_distinct(filter(s, (x, i) -> i > 0 and s[greatest(i - 1, 0)] = x))), r ->
        case when size(r) = 0 then 0L
        when size(r) <= {FEW} then cast(size(array_distinct(flatten(transform(
            filter(sequence(0, size(h) - 1), i -> array_contains(r, h[i])), i -> array(i, i + 1, i + 2))))) as bigint)
        else transform(array(array_sort(transform(h, (x, i) -> struct(x as x, i as i)))), p ->
            cast(size(array_distinct(flatten(transform(filter(sequence(0, size(p) - 1), j ->
                (j > 0 and p[greatest(j - 1, 0)].x = p[j].x) or (j < size(p) - 1 and p[least(j + 1, size(p) - 1)].x = p[j].x)),
                j -> array(p[j].i, p[j].i + 1, p[j].i + 2))))) as bigint))[0] end)[0])[0])[0] end""",
    "n_ellipsis_lines": rf"cast(regexp_count(q_text, '(?:\\.\\.\\.|\\x{{2026}}){_BLANK}(?:\\n|\\z)') as bigint)",
    "n_bullet_lines": rf"cast(regexp_count(q_text, '(?:\\A|\\n){_BLANK}[-*\\x{{2022}}]') as bigint)",
    "n_marks": r"cast(regexp_count(q_text, '[\\x00-\\x08\\x0E-\\x1F\\x21-\\x40\\x5B-\\x60\\x7B-\\x7F]') as bigint)",
    "n_stop_words": f"cast(size(array_intersect(q_words, array({_STOP}))) as bigint)",
    "n_distinct_words": "cast(size(array_distinct(q_words)) as bigint)",
    "n_distinct_pairs": """case when size(q_words) < 2 then 0L else
        cast(size(array_distinct(transform(sequence(0, size(q_words) - 2), i -> xxhash64(q_words[i], q_words[i + 1])))) as bigint) end""",
}

#: The base rules first, then the method's own. Limits are wide: they name junk, not style.
BASE = (
    Rule("too_few_words", ("n_words",), "n_words < 50"),
    Rule("repeated_windows", ("n_words", "n_repeat_words"), "100 * n_repeat_words > 50 * n_words"),
)
EXTRA = (
    Rule("symbols", ("n_words", "n_symbols"), "10 * n_symbols > n_words"),
    Rule("word_length", ("n_words", "word_chars"), "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    Rule("duplicate_lines", ("n_lines", "n_dup_lines"), "n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines"),
    Rule("ellipsis_lines", ("n_lines", "n_ellipsis_lines"), "n_lines >= 4 and 100 * n_ellipsis_lines > 30 * n_lines"),
    Rule("bullet_lines", ("n_lines", "n_bullet_lines"), "n_lines >= 4 and 100 * n_bullet_lines > 90 * n_lines"),
    Rule("letters", ("word_chars", "n_marks"), "100 * n_marks > 40 * word_chars"),
    Rule("stop_words", ("n_words", "n_stop_words"), "n_words >= 50 and n_stop_words < 2"),
    # every distinct word but the last begins a pair of its own: texts of many words need no pairs
    Rule("distinct_pairs", ("n_words", "n_distinct_words", "n_distinct_pairs"), "n_words >= 50 and case when 100 * (n_distinct_words - 1) >= 40 * n_words then false else 100 * n_distinct_pairs < 40 * n_words end"),
    Rule("distinct_words", ("n_words", "n_distinct_words"), "n_words >= 50 and 100 * n_distinct_words < 10 * n_words"),
)


def with_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = F.expr(r"trim(BOTH ' \t\n\u000b\u000c\r' FROM q_text)")
    words = F.when(trimmed == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    return docs.withColumn("q_text", text).withColumn("q_words", words)


def _sample(docs: DataFrame, text_col: str, key_col: str, measures: Sequence[str], rows: int) -> DataFrame:
    """About ``rows`` rows, never more, by the hash of their key, with ``measures``."""
    total = docs.count()
    key = F.xxhash64(key_col if key_col in docs.columns else text_col)
    # half as many again as asked for, as the hash may fall short; the limit bounds copies
    share = max(1, int(total / (1.5 * rows)))
    some = docs.filter(F.pmod(key, F.lit(share)) == 0).select(F.col(text_col).alias("q_in")).limit(rows)
    return written(with_words(some, "q_in").select("q_text", "q_words", *[F.expr(MEASURES[m]).alias(m) for m in measures]), 1)


def cascade_order(docs: DataFrame, rules: Sequence[Rule], text_col: str = "text", key_col: str = "doc_id", measures: Sequence[str] = (), rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejected share per second, both measured on a hash sample.

    A rule's cost is the least of several times less that of reading the sample;
    ``measures`` are those that every row has anyway and cost a rule nothing. The order
    bears on speed alone: a document is rejected if any rule rejects it. With no rows
    the order given stays.
    """
    sample = _sample(docs, text_col, key_col, measures, rows)

    def run(what) -> tuple[float, float]:
        times = []
        for _ in range(TIMES):
            began = time.perf_counter()
            got = sample.agg(what).first()[0]
            times.append(time.perf_counter() - began)
        return min(times), float(got or 0)

    idle, _ = run(F.sum(F.size("q_words")))
    scored = []
    for rule in rules:
        seconds, share = run(F.avg(F.expr(f"cast(({_inlined(rule, measures)}) as double)")))
        scored.append((share / max(seconds - idle, NOISE), rule))
    return [r for _, r in sorted(scored, key=lambda x: -x[0])]


def _inlined(rule: Rule, measures: Sequence[str]) -> str:
    """The rule's test with the measures that are no columns put in."""
    test = rule.reject
    for m in sorted(set(rule.needs) - set(measures), key=len, reverse=True):
        test = _inline(test, m)
    return test


def _inline(test: str, measure: str) -> str:
    return re.sub(rf"\b{measure}\b", lambda _: f"({MEASURES[measure]})", test)


def cascade(docs: DataFrame, rules: Sequence[Rule] = BASE + EXTRA, text_col: str = "text", measures: Sequence[str] = (), key_col: str = "doc_id", ordered: bool = False) -> DataFrame:
    """``docs`` plus ``kept``: true if no rule rejects the row.

    The rules run in the order of ``cascade_order``, or as given if ``ordered``, inside
    one CASE, so that a row which an early rule rejects never pays for the measures of a
    later one. ``measures`` are added as columns, computed for every row and then shared
    with the rules. Null texts count as empty; no row is dropped, repeated rows count
    each for itself; input columns named like an added one are replaced. Nothing is
    shuffled: a row's verdict needs that row only.
    """
    if not ordered:
        rules = cascade_order(docs, rules, text_col, key_col, measures)
    docs = docs.drop(*[c for c in (*measures, "kept", "q_text", "q_words") if c != text_col])
    df = with_words(docs, text_col)
    df = df.select("*", *[F.expr(MEASURES[m]).alias(m) for m in measures])
    case = "".join(f" when {_inlined(rule, measures)} then false" for rule in rules)
    return df.withColumn("kept", F.expr(f"case{case} else true end")).drop("q_text", "q_words")
