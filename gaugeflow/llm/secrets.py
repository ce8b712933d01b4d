"""Secret scan with multipart credential linking, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table

#: Parts of one credential are at most so many characters apart.
SCOPE = 200


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


def _assigned(words: list[str], value: str) -> str:
    return f"({'|'.join(map(_either_case, words))})[\"']?\\x20*[:=]\\x20*[\"']?({value})"


#: kind: (pattern, least characters of a match, group that they count, role, whether it is reported alone)
KINDS = {
    "assign": (_assigned(["password", "passwd", "secret", "token", "api_?key"], "[A-Za-z0-9+/_.=-]+"), 6, 2, "secret", True),
    "access": ("AKIA[A-Z0-9]+", 20, 0, "identity", True),
    # Runs are matched whole, so asking for their least length in the pattern finds the same ones.
    "hex": ("[0-9a-f]{24,}", 24, 0, "secret", True),
    "phrase": (_assigned(["pwd", "pass", "credentials?", "auth", "private_key", "access_key"], "[A-Za-z0-9+/_.=-]+"), 6, 2, "secret", False),
    "account": (_assigned(["user", "username", "login", "account", "client_id", "access_key_id"], "[A-Za-z0-9@._+-]+"), 3, 2, "identity", False),
    # As long as mail and host names can be; without bounds, a long run of letters is searched
    # anew from each of them, and a long chain of labels fills the matcher's stack.
    "address": ("[A-Za-z0-9._+-]{1,64}@[A-Za-z0-9-]{1,63}(?:[.][A-Za-z0-9-]{1,63}){1,8}", 6, 0, "identity", False),
    "endpoint": ("[A-Za-z][A-Za-z0-9+.-]{0,31}://[A-Za-z0-9.-]+(?::[0-9]+)?", 8, 0, "endpoint", False),
}
#: A plain string that every match of a pattern has; texts without it are not searched.
HINTS = {"access": "AKIA", "address": "@", "endpoint": "://"}
BASE = [k for k, v in KINDS.items() if v[4]]
SPAN = "array<struct<start:int,rank:int,stop:int>>"
#: Spans are gathered in runs of so many, so that a text with very many isn't copied for each.
RUN = 256


def spans_of(text: Column, kind: str) -> Column:
    """Matches of a kind as (start, rank, stop) in code points: leftmost, not overlapping; those
    too short are dropped after matching."""
    pattern, least, group, _, _ = KINDS[kind]
    rank = list(KINDS).index(kind)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    steps = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("match"), counted.alias("value"))
    none = F.expr(f"cast(array() as {SPAN})")

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        stop = start + F.length(x["match"])
        span = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), stop.alias("stop")))
        kept = F.length(x["value"]) >= least  # null after the last gap
        return F.struct(F.coalesce(stop, start).alias("at"), F.when(kept, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    def gathered(steps):
        def run(acc, k):
            part = F.aggregate(F.slice(steps, k * RUN + 1, RUN), F.struct(acc["at"].alias("at"), none.alias("spans")), step)
            return F.transform(F.array(part), lambda p: F.struct(p["at"].alias("at"), F.concat(acc["runs"], F.array(p["spans"])).alias("runs")))[0]

        start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{SPAN}>)").alias("runs"))
        return F.aggregate(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / RUN).cast("int")), start, run, lambda acc: F.flatten(acc["runs"]))

    hinted = F.contains(text, F.lit(HINTS[kind])) if kind in HINTS else F.lit(True)
    return F.when(hinted & text.rlike(pattern), F.transform(F.array(steps), gathered)[0]).otherwise(none)


def joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"], s["stop"])), ",")


def _as_parts(kind: str) -> Column:
    role, alone = KINDS[kind][3:]
    return F.transform(F.col(kind), lambda s: F.struct(s.alias("span"), F.lit(role).alias("role"), F.lit(alone).alias("alone")))


def _cells(scope: int, reach: int = 0) -> Column:
    """The cells, twice the scope wide, that a span touches with `reach` characters around it."""
    width = 2 * scope
    return F.explode(F.sequence(F.floor((F.col("span.start") - reach) / width), F.floor((F.col("span.stop") + reach) / width)))


def apart_from_base(parts: DataFrame, scope: int) -> DataFrame:
    """`parts(row, span, role, alone)` without the weak ones that overlap one reported alone: an
    interval join on the cells that both touch."""
    weak = parts.filter("NOT alone").select("row", "span", _cells(scope).alias("cell"))
    base = parts.filter("alone").select(F.col("row").alias("_row"), F.col("span").alias("_span"), _cells(scope).alias("_cell"))
    meet = (F.col("span.start") < F.col("_span.stop")) & (F.col("_span.start") < F.col("span.stop"))
    covered = weak.join(base, (F.col("row") == F.col("_row")) & (F.col("cell") == F.col("_cell")) & meet, "left_semi").select("row", "span").distinct()
    return parts.join(covered, ["row", "span"], "left_anti")


def linked_parts(parts: DataFrame, scope: int) -> DataFrame:
    """Of `parts(row, span, role, alone)` the weak ones (not reported alone) that have a
    complementary part within `scope` characters: a secret for identities and endpoints, one of
    these for secrets.

    An interval join: a part is placed in every cell that it touches, a partner in every cell
    within its reach, and the exact distance decides. Both sides of a semi join, so a weak part
    stays one row however many partners it has.
    """
    secret = F.col("role") == "secret"
    weak = parts.filter("NOT alone").select("row", "span", secret.alias("is_secret"), _cells(scope).alias("cell"))
    other = parts.select(F.col("row").alias("_row"), F.col("span").alias("_span"), (~secret).alias("for_secret"), _cells(scope, scope).alias("_cell"))
    near = (F.col("span.start") - F.col("_span.stop") <= scope) & (F.col("_span.start") - F.col("span.stop") <= scope)
    on = (F.col("row") == F.col("_row")) & (F.col("cell") == F.col("_cell")) & (F.col("is_secret") == F.col("for_secret")) & near
    return weak.join(other, on, "left_semi").select("row", "span").distinct()


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """key, n_assign, n_access, n_hex, base_sha256, spans of every document.

    Base kinds are always reported. Weak candidates (`phrase`, `account`, `address`, `endpoint`)
    are reported only where complementary parts co-occur within `scope` characters, and never
    where they overlap a base span. Null is an empty text, without spans: an empty string and its
    digest. Repeated rows and null keys each keep their row; an empty table gives none; other
    columns are ignored. The search is linear in a text's length and holds one text at a time.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    # Written once: the texts are searched a single time, and the row numbers are settled.
    found = docs.select(F.col(key).alias("id"), *(spans_of(body, k).alias(k) for k in KINDS))
    found = staged(found.withColumn("row", F.monotonically_increasing_id()), "parts")

    several = found.filter(" OR ".join(f"size({k}) > 0" for k in KINDS if k not in BASE))
    parts = several.select("row", F.explode(F.concat(*(_as_parts(k) for k in KINDS))).alias("p")).select("row", "p.span", "p.role", "p.alone")
    links = linked_parts(apart_from_base(parts, scope), scope).groupBy("row").agg(F.collect_list("span").alias("more"))
    base, none = F.concat(*BASE), F.expr(f"cast(array() as {SPAN})")
    return found.join(links, "row", "left").select(
        F.col("id").alias(key),
        *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.concat(base, F.coalesce("more", none))).alias("spans"),
    )


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    rows = []
    for rank, (kind, (pattern, least, group, role, alone)) in enumerate(KINDS.items()):
        quoted = pattern.replace("'", "''")
        rows.append(
            f"SELECT row, {rank} AS rank, '{kind}' AS kind, '{role}' AS role, {alone} AS alone, {least} AS least, "
            f"unnest(string_split_regex(text, '{quoted}')) AS gap, "
            f"unnest(list_append(regexp_extract_all(text, '{quoted}', 0), NULL)) AS match, "
            f"unnest(list_append(regexp_extract_all(text, '{quoted}', {group}), NULL)) AS value, "
            f"unnest(range(len(regexp_extract_all(text, '{quoted}', 0)) + 1)) AS i FROM d WHERE regexp_matches(text, '{quoted}')"
        )
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
raw AS ({' UNION ALL '.join(rows)}),
placed AS (
  SELECT *, (sum(length(gap) + coalesce(length(match), 0)) OVER (PARTITION BY row, rank ORDER BY i) - coalesce(length(match), 0))::BIGINT AS a
  FROM raw
), spans AS (
  SELECT row, rank, kind, role, alone, a, a + length(match) AS b FROM placed WHERE length(value) >= least
), part AS (
  SELECT * FROM spans s WHERE alone OR NOT EXISTS (
    SELECT 1 FROM spans t WHERE t.row = s.row AND t.alone AND t.a < s.b AND s.a < t.b)
), kept AS (
  SELECT * FROM part s WHERE alone OR EXISTS (
    SELECT 1 FROM part t WHERE t.row = s.row AND (t.role = 'secret') <> (s.role = 'secret')
      AND s.a - t.b <= {SCOPE} AND t.a - s.b <= {SCOPE})
), told AS (
  SELECT row, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) FILTER (alone) AS base,
    string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) AS spans
  FROM kept GROUP BY row
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN told USING (row)
"""


SQL = _oracle()
