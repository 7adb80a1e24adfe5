"""Secrets in texts, in DataFrame operations only: base patterns, and parts of credentials that are linked.

A span's place comes from cutting the text at the pattern: the lengths of the pieces and matches before it
add up to its start, in code points.  Parts too weak to report alone (short access identifiers, bare random
strings, endpoints) are joined by interval with the parts that complete them in the same text, their scope: a
weak identifier needs a secret, a weak secret an identifier, an endpoint both, with a gap of ``SCOPE`` at most.

The join is a count by binary search: of intervals that are sorted by start, and by end, those that begin at or
before one place less those that end before another are the ones between.  A text's parts are in its row, so
nothing is exchanged, and the work grows with their number times its logarithm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCOPE = 300
# The base kinds and their patterns, in the order in which kinds are listed.
BASE = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]{24,}",
}
#: Weak parts: kind, role and pattern.
WEAK = {
    "part_access": r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{8,15}|A(?:SIA|IDA|ROA|GPA)[A-Z0-9]{12,})(?![A-Za-z0-9])",
    "part_secret": r"(?<![A-Za-z0-9+/])(?=[A-Za-z+/]{0,39}[0-9])(?=[^A-Z]{0,39}[A-Z])(?=[^a-z]{0,39}[a-z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])",
    "part_endpoint": r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[A-Za-z0-9._~/-]*)?",
}
KINDS = [*BASE, *WEAK]
SPAN = "struct<start:bigint,kind:int,end:bigint>"
#: Sums are carried on in stretches of so many, since appending to an array copies it.
STRETCH = 512


def _quoted(pattern: str) -> str:
    return "r'" + pattern + "'" if "'" not in pattern else 'r"' + pattern.replace('"', "\\x22") + '"'


def running(column: str) -> str:
    """The running sums of an array<bigint> column."""
    carry = "(s, x) -> named_struct('at', s.at + x, 'out', concat(s.out, array(s.at + x)))"
    start = "named_struct('at', 0L, 'out', cast(array() as array<bigint>))"
    blocks = f"transform(sequence(0, greatest(size({column}) - 1, 0) div {STRETCH}), b -> slice({column}, cast(b * {STRETCH} + 1 as int), {STRETCH}))"
    own = f"transform({blocks}, x -> aggregate(x, {start}, {carry}, s -> s.out))"
    before = f"aggregate(transform({blocks}, x -> aggregate(x, 0L, (s, v) -> s + v)), {start}, {carry}, s -> s.out)"
    return f"flatten(zip_with({own}, {before}, (x, e) -> transform(x, v -> v + e - x[size(x) - 1])))"


def with_spans(df: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """Adds __<kind>, array<struct<start, kind, end>> of each pattern's matches, leftmost and without overlap.

    Each array is read more than once in the next step, so the optimiser keeps the steps apart.
    """
    columns, none = df.columns, "cast(array() as array<bigint>)"
    size = lambda of: f"transform({of}, h -> cast(length(h) as bigint))"
    sizes, steps, spans = {}, {}, {}
    for kind, pattern in patterns.items():
        q = _quoted(pattern)
        when = lambda of, q=q: F.expr(f"if({text} rlike {q}, {of}, {none})")
        sizes[f"__n_{kind}"], sizes[f"__g_{kind}"] = when(size(f"regexp_extract_all({text}, {q}, 0)")), when(size(f"split({text}, {q}, -1)"))
        if kind == "assign":
            sizes["__v_assign"] = when(size(f"regexp_extract_all({text}, {q}, 2)"))
        n, g, at = f"__n_{kind}", f"__g_{kind}", f"__at_{kind}"
        steps[f"__s_{kind}"] = F.expr(f"if(size({n}) = 0, {none}, transform(slice({g}, 1, size({n})), (x, i) -> x + if(i > 0, {n}[greatest(i - 1, 0)], 0L)))")
        steps[at] = F.expr(f"if(size(__s_{kind}) = 0, {none}, {running(f'__s_{kind}')})")
        ok = {"assign": "__v_assign[i] >= 6", "access": f"{n}[i] >= 20"}.get(kind, "true")
        span = f"if({ok}, named_struct('start', x, 'kind', {KINDS.index(kind)}, 'end', x + {n}[i]), null)"
        spans[f"__{kind}"] = F.expr(f"filter(transform({at}, (x, i) -> {span}), s -> s is not null)")
    df = df.withColumns(sizes)
    df = df.withColumns({c: e for c, e in steps.items() if c.startswith("__s_")})
    df = df.withColumns({c: e for c, e in steps.items() if c.startswith("__at_")})
    return df.select(*columns, *[e.alias(c) for c, e in spans.items()])


def _at_most(column: str, value: str) -> str:
    """How many of a sorted array<bigint> column are at or below a value."""
    mid = "((s.low + s.high) div 2)"
    step = f"if(s.low >= s.high, s, if({column}[int({mid})] <= {value}, named_struct('low', {mid} + 1, 'high', s.high), named_struct('low', s.low, 'high', {mid})))"
    return f"aggregate(sequence(1, 32), named_struct('low', 0L, 'high', cast(size({column}) as bigint)), (s, i) -> {step}, s -> s.low)"


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """All columns of ``docs`` plus spans, array<struct<start, kind, end>> by start and kind (numbers of
    ``KINDS``): every base span, and weak parts that others in the same text complete, at most ``scope``
    characters before their start or behind their end.

    Null or empty text: no spans.  Repeated rows are repeated.  A weak part that begins inside a base span is no
    part.  A column named spans is replaced; all others, whatever their names, pass as they are.  An empty table
    gives an empty one.
    """
    columns = [c for c in docs.columns if c != "spans"]
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__row"), F.coalesce(F.col("text"), F.lit("")).alias("__text"))
    df = with_spans(df, "__text", BASE | WEAK).drop("__text")
    sized = lambda *kinds: " + ".join(f"size(__{k})" for k in kinds)
    linkable = f"({sized('access', 'part_access')}) > 0 and ({sized('assign', 'hex', 'part_secret')}) > 0 and ({sized(*WEAK)}) > 0"
    edge = lambda of, side: f"sort_array(transform({of}, s -> s.{side}))"
    only = lambda of, empty="bigint": F.expr(f"if(__linkable, {of}, cast(array() as array<{empty}>))")
    base = f"concat({', '.join(f'__{k}' for k in BASE)})"
    df = df.withColumn("__base", F.expr(base)).withColumn("__linkable", F.expr(linkable))
    df = df.withColumns({f"__base_{side}": only(edge("__base", side)) for side in ("start", "end")})
    free = f"{_at_most('__base_start', 'w.start')} = {_at_most('__base_end', 'w.start')}"
    df = df.withColumns({f"__free_{k}": only(f"filter(__{k}, w -> {free})", SPAN) for k in WEAK})
    roles = {"access": "concat(__access, __free_part_access)", "secret": "concat(__assign, __hex, __free_part_secret)"}
    df = df.withColumns({f"__{role}_{side}": only(edge(of, side)) for role, of in roles.items() for side in ("start", "end")})
    near = lambda role: f"{_at_most(f'__{role}_start', f'(w.end + {scope})')} > {_at_most(f'__{role}_end', f'(w.start - {scope} - 1)')}"
    needs = {"part_access": near("secret"), "part_secret": near("access"), "part_endpoint": f"{near('access')} and {near('secret')}"}
    linked = ", ".join(f"filter(__free_{k}, w -> {needs[k]})" for k in WEAK)
    df = df.withColumn("__spans", F.expr(f"sort_array(if(__linkable, concat(__base, {linked}), __base))"))
    return df.select(*[F.col("__row")[c].alias(c) for c in columns], F.col("__spans").alias("spans"))


def joined(spans: str, base_only: bool = False) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = "array(" + ",".join(f"'{k}'" for k in KINDS) + ")"
    own = f"filter({spans}, s -> s.kind < {len(BASE)})" if base_only else spans
    return F.expr(f"array_join(transform({own}, s -> concat({names}[s.kind], ':', s.start, ':', s.end)), ',')")


def count_of(spans: str, kind: str) -> Column:
    return F.expr(f"cast(size(filter({spans}, s -> s.kind = {KINDS.index(kind)})) as bigint)")


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The rows of ``docs``, all columns as they are, with each stretch that spans cover put to ``mark`` in
    the text; overlapping spans are one stretch.  Null texts stay null."""
    found = scan(docs.select(F.struct("*").alias("row"), "text"))  # no column of theirs meets one of the scan's
    # Ascending by start: a span that begins before the end so far only lengthens the stretch.
    step = f"""named_struct('at', greatest(s.at, x.end), 'out', if(x.start >= s.at,
        concat(s.out, substring(text, int(s.at) + 1, int(x.start - s.at)), '{mark}'), s.out))"""
    body = f"aggregate(spans, named_struct('at', 0L, 'out', ''), (s, x) -> {step}, s -> concat(s.out, substring(text, int(s.at) + 1)))"
    text = F.expr(f"if(size(spans) = 0 or text is null, text, {body})").alias("text")
    return found.select(*[text if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
