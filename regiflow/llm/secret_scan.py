"""Secret scan with multipart credential linking.

Base secrets are found by fixed patterns and always reported.  Weaker parts
(key names with a value, long mixed tokens, endpoints) are only candidates: an
interval join within scopes reports a candidate when the parts that complete a
credential stand near it: an access identifier near a secret, a secret near an
identifier, an endpoint near both.  Near is a distance of characters, or a
greater one within a paragraph (a block without an empty line).

Only DataFrame functions are used.  Texts are read once; what is written and
shuffled afterwards is positions.  The join runs on (row, cell of a scope's
characters), so a group holds no more than the parts that fit into one cell;
it is a semi join, so pairs are never emitted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

SCOPE = 200                  # characters between parts of a credential
PARAGRAPH_SCOPE = 2000       # and within a paragraph
_BREAK = r"\n[ \t\r\n]*\n"
ID, SECRET, ENDPOINT = "id", "secret", "endpoint"


@dataclass(frozen=True)
class Part:
    """A kind of span: its pattern, the group whose length counts and the
    least such length, the role it has in a credential, and what a candidate's
    text must also contain."""

    name: str
    pattern: str
    group: int
    least: int
    role: str
    base: bool
    also: tuple[str, ...] = ()


# In the order of their kinds.  The base patterns are fixed values.
PARTS = (
    Part("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, SECRET, True),
    Part("access", r"AKIA[A-Z0-9]+", 0, 20, ID, True),
    Part("hex", r"[0-9a-f]{24,}", 0, 24, SECRET, True),      # the runs [0-9a-f]+ of 24 or more
    Part("key_id", r"""(?i:(client|account|access|app|key|user)[_-]?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]+)|(?:ASIA|AROA|AIDA)[A-Z0-9]{16,}""",
         0, 8, ID, False),
    Part("long_token", r"[A-Za-z0-9+/_-]{24,}={0,2}", 0, 24, SECRET, False, ("[0-9]", "[A-Za-z]")),
    Part("endpoint", r"""https?://[^\s"'<>)]+|(?i:endpoint|hostname|base_?url)["']?\x20*[:=]\x20*["']?[A-Za-z0-9./:_-]+""", 0, 8, ENDPOINT, False),
)


def _found(k: int, part: Part) -> Column:
    """All matches of one kind as (kind, nr, gap before, length, paragraphs
    that end in the gap, ok); no match holds a line break."""
    also = "".join(f" and m{k}[i] rlike '{a}'" for a in part.also)
    return F.expr(f"""
        if(m{k} is null, array(), transform(sequence(0, size(m{k}) - 1),
           i -> named_struct('kind', {k}, 'nr', i, 'gap', length(g{k}[i]), 'len', length(m{k}[i]),
                             'breaks', if(position('\n' in g{k}[i]) = 0, 0, regexp_count(g{k}[i], r'{_BREAK}')),
                             'ok', length({'v' if part.group else 'm'}{k}[i]) >= {part.least}{also})))""")


def _candidates(text: Column) -> list[Column]:
    """Per kind: all matches (m), the text between them (g; ``split`` by the
    pattern gives it) and the group that counts (v).  Lengths of gaps and
    matches add up to positions in code points."""
    t = F.coalesce(text, F.lit(""))
    cols = []
    for k, p in enumerate(PARTS):
        pattern = F.lit(p.pattern)
        hit = t.rlike(p.pattern)
        cols += [F.when(hit, F.regexp_extract_all(t, pattern, F.lit(0))).alias(f"m{k}"),
                 F.when(hit, F.split(t, p.pattern, -1)).alias(f"g{k}")]
        if p.group:
            cols.append(F.when(hit, F.regexp_extract_all(t, pattern, F.lit(p.group))).alias(f"v{k}"))
    return cols


def _matches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(row, doc_id, found)``: the matches of every kind in every text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *_candidates(F.col(text_col)))
    return rows.select(F.monotonically_increasing_id().alias("row"), "doc_id",
                       F.concat(*(_found(k, p) for k, p in enumerate(PARTS))).alias("found"))


def _positions(matches: DataFrame) -> DataFrame:
    """``(row, kind, start, end, paragraph)`` of the matches that count."""
    before = Window.partitionBy("row", "kind").orderBy("nr").rowsBetween(Window.unboundedPreceding, 0)
    return (matches.select("row", F.explode("found").alias("f")).select("row", "f.*")
            .withColumn("end", F.sum(F.col("gap") + F.col("len")).over(before))
            .withColumn("paragraph", F.sum("breaks").over(before))
            .filter("ok").select("row", "kind", (F.col("end") - F.col("len")).alias("start"), "end", "paragraph"))


def _cells(spans: DataFrame, scope: int, reach: int) -> DataFrame:
    """Spans once per cell that they touch when widened by ``reach``."""
    return spans.withColumn("cell", F.explode(F.sequence(
        F.floor((F.col("start") - reach) / scope), F.floor((F.col("end") + reach) / scope))))


_SPAN = ["row", "kind", "start", "end", "paragraph"]


def _near(candidates: DataFrame, parts: DataFrame, reach: int, in_paragraph: bool = False) -> DataFrame:
    """Candidates with one of ``parts`` at most ``reach`` characters away,
    ``in_paragraph``: in their own paragraph."""
    cell = max(reach, SCOPE)
    a, b = _cells(candidates, cell, reach).alias("a"), _cells(parts, cell, 0).alias("b")
    on = (F.col("a.row") == F.col("b.row")) & (F.col("a.cell") == F.col("b.cell")) & \
        (F.col("b.start") < F.col("a.end") + reach) & (F.col("a.start") < F.col("b.end") + reach)
    if in_paragraph:
        on = on & (F.col("a.paragraph") == F.col("b.paragraph"))
    return a.join(b, on, "left_semi").select(*_SPAN).distinct()


def _linked(spans: DataFrame, scope: int, paragraph_scope: int) -> DataFrame:
    """The candidates that stand near the parts completing a credential."""
    def role(*names, base=None):
        return [k for k, p in enumerate(PARTS) if p.role in names and base in (None, p.base)]

    def near(candidates, parts):
        found = _near(candidates, parts, scope)
        return found.unionAll(_near(candidates, parts, paragraph_scope, True)).distinct() if paragraph_scope else found

    base = spans.filter(F.col("kind").isin([k for k, p in enumerate(PARTS) if p.base]))
    weak = spans.filter(F.col("kind").isin([k for k, p in enumerate(PARTS) if not p.base]))
    weak = weak.join(_near(weak, base, 0), _SPAN, "left_anti")
    parts = base.unionAll(weak)
    ids = parts.filter(F.col("kind").isin(role(ID)))
    secrets = parts.filter(F.col("kind").isin(role(SECRET)))
    by_id = near(weak.filter(F.col("kind").isin(role(SECRET, ENDPOINT, base=False))), ids)
    by_secret = near(weak.filter(F.col("kind").isin(role(ID, ENDPOINT, base=False))), secrets)
    ends = F.col("kind").isin(role(ENDPOINT))
    return by_id.filter(~ends).unionAll(by_secret.filter(~ends)).unionAll(by_id.filter(ends).join(by_secret.filter(ends), _SPAN, "left_semi"))


def scan(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE,
         paragraph_scope: int = PARAGRAPH_SCOPE) -> DataFrame:
    """``(row, doc_id, found)`` per row of ``docs``: ``found`` is the array of
    (start, kind, end), sorted, empty where nothing was found.  ``row`` only
    tells apart rows of this result."""
    matches = materialize(spark, _matches(docs, id_col, text_col), "secret-matches")
    spans = materialize(spark, _positions(matches), "secret-spans")
    base = spans.filter(F.col("kind").isin([k for k, p in enumerate(PARTS) if p.base]))
    found = (base.unionAll(_linked(spans, scope, paragraph_scope)).groupBy("row")
             .agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("found")))
    return matches.select("row", "doc_id").join(found, "row", "left").select(
        "row", "doc_id", F.coalesce("found", F.expr("cast(array() as array<struct<start:bigint,kind:int,end:bigint>>)")).alias("found"))


def _is(kind: int):
    return lambda span: span["kind"] == kind


def _written(kinds: list[int]) -> Column:
    names = F.array(*(F.lit(p.name) for p in PARTS))
    return F.array_join(F.transform(
        F.filter("found", lambda s: s["kind"].isin(kinds)),
        lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE,
         paragraph_scope: int = PARAGRAPH_SCOPE) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans)`` per row of
    ``docs``.

    Defined results: a null text counts as empty; a text without a finding has
    zero counts, the digest of no bytes and empty ``spans``; spans of several
    kinds may overlap and are all listed; repeated rows are scanned each; null
    ids stay null; an empty table gives no rows; other columns are not read.
    """
    every, base = list(range(len(PARTS))), [k for k, p in enumerate(PARTS) if p.base]
    count = [F.size(F.filter("found", _is(k))).cast("long").alias(f"n_{PARTS[k].name}") for k in base]
    return scan(spark, docs, id_col, text_col, scope, paragraph_scope).select(
        "doc_id", *count, F.sha2(_written(base).cast("binary"), 256).alias("base_sha256"), _written(every).alias("spans"))


def redact(spark: SparkSession, docs: DataFrame, text_col: str = "text", scope: int = SCOPE,
           paragraph_scope: int = PARAGRAPH_SCOPE, marker: str = "[SECRET]") -> DataFrame:
    """``docs`` with every reported span of ``text_col`` replaced by
    ``marker``; overlapping spans become one.

    All rows and columns stay (any names); a null text stays null; texts
    without a finding are unchanged.  Only rows with a candidate are joined
    with their findings, so most texts are not shuffled.
    """
    rows = docs.select(F.struct("*").alias("doc"))
    text = F.col(f"doc.`{text_col}`")
    rows = materialize(
        spark, rows.select("doc", *_candidates(text)).select(
            F.monotonically_increasing_id().alias("row"), "doc",
            F.concat(*(_found(k, p) for k, p in enumerate(PARTS))).alias("found")),
        "secret-rows")
    spans = materialize(spark, _positions(rows), "secret-spans")
    base = spans.filter(F.col("kind").isin([k for k, p in enumerate(PARTS) if p.base]))
    found = (base.unionAll(_linked(spans, scope, paragraph_scope)).groupBy("row")
             .agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("spans")))
    hit = F.size("found") > 0
    clean = rows.filter(~hit).select("doc")
    open_ = F.aggregate(
        "spans", F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda a, s: F.struct(
            F.when(s["start"] >= a["at"], F.concat(a["out"], F.substring(text, a["at"].cast("int") + 1, (s["start"] - a["at"]).cast("int")), F.lit(marker)))
            .otherwise(a["out"]).alias("out"),
            F.greatest(a["at"], s["end"]).alias("at")),
        lambda a: F.concat(a["out"], F.substring(text, a["at"].cast("int") + 1, F.length(text))))
    changed = (rows.filter(hit).join(found, "row", "left")
               .select(F.col("doc").withField(f"`{text_col}`", F.when(F.col("spans").isNull(), text).otherwise(open_)).alias("doc")))
    return clean.unionAll(changed).select("doc.*")
