"""Personal data in texts, found with DataFrame functions alone.

Patterns propose spans, checksums (Luhn for cards, mod 97 for bank accounts, value ranges for addresses) confirm them,
and words shortly before a span raise its score. Spans of the four base kinds are always kept, whatever their score; the
further kinds (`iban`, `ssn`) are kept when their score reaches `threshold`.

Places of spans are sums of the lengths before them, taken in blocks, so that a text's cost grows with its length and not
with the square of its spans.

Edge cases: a null or empty text has no spans; equal texts have equal spans; an empty table gives an empty table; other
columns of the input are never read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTITY = "array<struct<s:int,k:int,kind:string,e:int,score:double>>"


@dataclass(frozen=True)
class Kind:
    """A kind of data: a cheap test for the text, a pattern that is linear in the text, a check, a score.

    The check of a match t is true or false, or how many of its characters count.
    """

    name: str
    gate: str
    pattern: str
    valid: str
    score: float
    words: str
    base: bool = True
    part: bool = False  # the check gives a length


#: Whether the letters and digits of c make a bank account's checksum.
MOD97 = (
    "length(replace(c, ' ', '')) between 15 and 34 and aggregate(transform(split(substr(replace(c, ' ', ''), 5) || left(c, 4), ''),"
    " x -> if(x between '0' and '9', ascii(x) - 48, ascii(x) - 55)), 0, (a, x) -> (a * if(x > 9, 100, 10) + x) % 97) = 1"
)

# The patterns name the same leftmost matches as the plain forms; look-behinds with \G only stop the search from
# trying again inside a run that already failed, and possessive loops keep Java from recursing on long runs.
KINDS = (
    Kind(
        "email",
        "instr(text, '@') > 0",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "true",
        0.9,
        r"(?i)\b(e-?mail|contact|write|mailto)\b",
    ),
    Kind(
        "ip",
        r"text rlike '[0-9]\\.[0-9]'",
        r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        "forall(split(t, '[.]'), p -> length(ltrim('0', p)) <= 3 and int('0' || right(ltrim('0', p), 3)) <= 255)",
        0.6,
        r"(?i)\b(ip|host|server|address)\b",
    ),
    # A match is a whole chain of digits joined by single blanks or hyphens, so its length can stand in the pattern.
    Kind(
        "card",
        r"text rlike '[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]'",
        r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}(?![\x20-]?[0-9])",
        "luhn_check(regexp_replace(t, '[^0-9]', ''))",
        0.8,
        r"(?i)\b(card|visa|credit|payment)\b",
    ),
    Kind(
        "phone",
        "instr(text, '+') > 0",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        "length(regexp_replace(t, '[^0-9]', '')) between 10 and 15",
        0.7,
        r"(?i)\b(tel|phone|call|mobile|fax)\b",
    ),
    # Unbroken, or in groups of four; what follows a whole number of groups may look like another one, so the check may
    # leave out up to two.
    Kind(
        "iban",
        r"text rlike '[A-Z]{2}[0-9]{2}\\x20?[A-Z0-9]{4}'",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,4})?)(?![A-Za-z0-9])",
        f"coalesce(length(get(filter(transform(sequence(0, least(2, size(split(t, ' ')) - 1)), d -> array_join(slice(split(t, ' '), 1, size(split(t, ' ')) - d), ' ')), c -> {MOD97}), 0)), 0)",
        0.8,
        r"(?i)\b(iban|account|bank)\b",
        base=False,
        part=True,
    ),
    Kind(
        "ssn",
        r"text rlike '[0-9]{3}-[0-9]{2}-[0-9]{4}'",
        r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        "not t rlike '^(000|666|9..)' and substr(t, 5, 2) <> '00' and right(t, 4) <> '0000'",
        0.3,
        r"(?i)\b(ssn|social security|tax id)\b",
        base=False,
    ),
)


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


BLOCK = 64


def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


PLUS, MOST = "{} + {}".format, "greatest({}, {})".format


def _before(values: str, op: Callable[[str, str], str]) -> str:
    """SQL of an array of what `op` makes of all numbers before each place, 0 at the first.

    Blocks of BLOCK numbers are folded, and blocks of those: no place looks at more than a block on each level.
    """

    def fold(array: str, start: str, n: str) -> str:
        return f"aggregate(slice({array}, int({start}) + 1, int({n})), 0, (x, y) -> {op('x', 'y')})"

    def blocks(array: str) -> str:
        return f"transform(sequence(0, int(size({array}) div {BLOCK})), b -> {fold(array, f'b * {BLOCK}', str(BLOCK))})"

    def within(array: str, tops: str) -> str:
        block = f"(i div {BLOCK})"
        return f"transform({array}, (v, i) -> {op(f'{tops}[int({block})]', fold(array, f'{block} * {BLOCK}', f'i % {BLOCK}'))})"

    tops = f"transform(b2, (v, i) -> {fold('b2', '0', 'i')})"
    return _let("b0", values, _let("b1", blocks("b0"), _let("b2", blocks("b1"), _let("t2", tops, _let("t1", within("b1", "t2"), within("b0", "t1"))))))


def _spans(at: int, kind: Kind, reach: int, boost: float, threshold: float) -> Column:
    """Array of spans of one kind."""
    pattern = _quoted(kind.pattern)
    back = reach // 4 + 1  # matches, of four characters at least, that can lie in reach
    near = f"right(aggregate(slice(f, greatest(i - {back}, 0) + 1, least(i, {back})), '', (a, y) -> a || y.r || y.t) || m.r, {reach})"
    length = _let("t", "m.t", kind.valid if kind.part else f"if({kind.valid}, length(t), 0)")
    span = f"struct(p[i] + m.g as s, {at} as k, '{kind.name}' as kind, p[i] + m.g + {length} as e, least(1D, double({kind.score}) + if({near} rlike {_quoted(kind.words)}, {boost}D, 0D)) as score)"
    kept = "m.e > m.s" + ("" if kind.base else f" and m.score >= {threshold}D")
    found = f"filter(zip_with(split(text, {pattern}), regexp_extract_all(text, {pattern}, 0), (g, t) -> struct(length(g) as g, right(g, {reach}) as r, t as t)), m -> m.t is not null)"
    spans = _let("f", found, _let("p", _before("transform(f, m -> m.g + length(m.t))", PLUS), f"filter(transform(f, (m, i) -> {span}), m -> {kept})"))
    return F.expr(f"case when {kind.gate} then {spans} else cast(array() as {ENTITY}) end")


def find(docs: DataFrame, reach: int = 40, boost: float = 0.3, threshold: float = 0.5) -> DataFrame:
    """(doc_id, text, entities): entities are (s, k, kind, e, score) by start, then kind; code points, end exclusive."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = base.select("doc_id", "text", *[_spans(i, k, reach, boost, threshold).alias(f"k{i}") for i, k in enumerate(KINDS)])
    return found.select("doc_id", "text", F.array_sort(F.concat(*[f"k{i}" for i in range(len(KINDS))])).alias("entities"))


def digest(found: DataFrame) -> DataFrame:
    """The contract's row of each document: counts and hash of the base spans, all spans as text."""
    line = "x -> x.kind || ':' || x.s || ':' || x.e"
    n = sum(k.base for k in KINDS)
    return found.select(
        "doc_id",
        *[F.expr(f"cast(size(filter(entities, x -> x.k = {i})) as bigint)").alias(f"n_{k.name}") for i, k in enumerate(KINDS) if k.base],
        F.expr(f"sha2(array_join(transform(filter(entities, x -> x.k < {n}), {line}), ','), 256)").alias("base_sha256"),
        F.expr(f"array_join(transform(entities, {line}), ',')").alias("spans"),
    )


CHUNK = 1024


def redact(docs: DataFrame, reach: int = 40, boost: float = 0.3, threshold: float = 0.5) -> DataFrame:
    """The same rows and columns; every span in `text` becomes its kind in brackets, overlapping spans one. Null stays null.

    The text is cut into chunks, so that what stands between two spans is read from where it stands.
    """
    marks = [_spans(i, k, reach, boost, threshold) for i, k in enumerate(KINDS)]

    def piece(a: str, b: str) -> str:
        """SQL of the characters from a to b."""
        first, last = f"int({a} div {CHUNK})", f"int({b} div {CHUNK})"
        across = f"concat(substr(c[{first}], {a} % {CHUNK} + 1), array_join(slice(c, {first} + 2, {last} - {first} - 1), ''), coalesce(left(get(c, {last}), {b} % {CHUNK}), ''))"
        return f"if({first} = {last}, substr(c[{first}], {a} % {CHUNK} + 1, {b} - {a}), {across})"

    ends = f"concat({_before('transform(__spans, x -> x.e)', MOST)}, array(aggregate(__spans, 0, (a, x) -> greatest(a, x.e))))"
    pieces = f"transform(__spans, (x, i) -> if(x.s < q[i], '', {piece('q[i]', 'x.s')} || '[' || upper(x.kind) || ']'))"
    tail = f"if(q[size(__spans)] < length(text), {piece('q[size(__spans)]', 'length(text)')}, '')"
    text = _let("c", f"regexp_extract_all(text, '(?s).{{1,{CHUNK}}}', 0)", _let("q", ends, f"array_join({pieces}, '') || {tail}"))
    marked = docs.withColumn("__spans", F.array_sort(F.concat(*marks)))
    return marked.select(*[(F.when(F.size("__spans") > 0, F.expr(text)).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c)) for c in docs.columns])
