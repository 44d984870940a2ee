"""Secret scan over an incremental ledger of blobs, in DataFrame functions only.

Every distinct text is a blob named by its SHA-256. The ledger holds, for each blob and rule version that was scanned,
the spans found; a run scans the blobs for which the ledger lacks a rule version and joins all findings back to every
path (document) of the blob.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh_path, text_or_empty

#: Rows of one blob are dealt over so many tasks when findings are joined back.
SALT = 32
#: Matches whose positions are summed in one go.
RUN = 256
LEDGER = "blob string, rule string, version int, spans array<struct<start:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """A regular expression (of Java, and read alike by RE2), applied leftmost and without overlap; a match shorter than least in the group is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1


#: The first three are fixed by the contract. A run of at least n characters that is greedy is the run of any length with the shorter ones dropped.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("host_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
)
BASE = ("assign", "access", "hex")


def spans(text: Column, rule: Rule) -> Column:
    """Start and end of all matches in code points: the pieces between matches and the matches take turns, so their lengths add up to positions.

    Positions are summed in runs of RUN matches, each from the sum of those before it, so that work grows with the matches, not their square.
    """
    found = F.regexp_extract_all(text, F.lit(f"({rule.pattern})" if rule.group == 0 else f"(?:{rule.pattern})"), F.lit(0))
    checked = F.transform(found, lambda m: F.struct(F.length(m).alias("n"), (F.length(F.regexp_extract(m, rule.pattern, rule.group)) >= rule.least).alias("ok")))
    between = F.transform(F.split(text, rule.pattern, -1), F.length)
    empty = F.array().cast("array<struct<start:int,end:int,ok:boolean>>")

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + pair["gap"]
        end = start + pair["m"]["n"]
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(start.alias("start"), end.alias("end"), pair["m"]["ok"].alias("ok")))).alias("out"))

    def run_from(state: Column, run: Column) -> Column:
        total = F.aggregate(run, F.lit(0), lambda n, pair: n + pair["gap"] + pair["m"]["n"])
        return F.struct((state["at"] + total).alias("at"), F.concat(state["runs"], F.array(F.struct(state["at"].alias("from"), run.alias("run")))).alias("runs"))

    pairs = F.zip_with(F.slice(between, 1, F.size(checked)), checked, lambda gap, m: F.struct(gap.alias("gap"), m.alias("m")))
    none = F.array().cast("array<struct<from:int,run:array<struct<gap:int,m:struct<n:int,ok:boolean>>>>>")
    starts = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / RUN).cast("int"))
    runs = F.transform(F.array(pairs), lambda every: F.transform(starts, lambda k: F.slice(every, k * RUN + 1, RUN)))[0]
    from_each = F.aggregate(runs, F.struct(F.lit(0).alias("at"), none.alias("runs")), run_from)["runs"]
    walked = F.flatten(F.transform(from_each, lambda r: F.aggregate(r["run"], F.struct(r["from"].alias("at"), empty.alias("out")), step)["out"]))
    kept = F.transform(F.filter(walked, lambda s: s["ok"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return F.when(F.size(found) > 0, kept).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def blobs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Each distinct text once: blob and text. Copies are reduced where they are read, before the shuffle."""
    return docs.select(F.sha2(text_or_empty(text_col), 256).alias("blob"), text_or_empty(text_col).alias("text")).dropDuplicates(["blob"])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None, *, text_col: str = "text") -> DataFrame:
    """New ledger rows (blob, rule, version, spans) for the pairs of blob and rule version that the ledger lacks; clean blobs have empty spans."""
    todo = blobs(docs, text_col)
    if ledger is None:
        seen = F.array().cast("array<string>")
    else:
        known = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws("@", "rule", F.col("version").cast("string"))).alias("seen"))
        todo = todo.join(known, "blob", "left")
        seen = F.coalesce(F.col("seen"), F.array().cast("array<string>"))
    each = [
        F.when(~F.array_contains(seen, f"{r.kind}@{r.version}"), F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"), spans(F.col("text"), r).alias("spans")))
        for r in rules
    ]
    return todo.select("blob", F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("x")).select("blob", "x.rule", "x.version", "x.spans")


def findings(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row for each blob with a span under the rules' current versions: blob and found, an array of (start, rank, kind, end) in order."""
    current = F.array(*[F.lit(f"{r.kind}@{r.version}") for r in rules])
    rank = F.create_map(*[F.lit(x) for k, r in enumerate(rules) for x in (r.kind, k)])
    kept = ledger.filter((F.size("spans") > 0) & F.array_contains(current, F.concat_ws("@", "rule", F.col("version").cast("string"))))
    one = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.element_at(rank, F.col("rule")).alias("rank"), F.col("rule").alias("kind"), s["end"].alias("end")))
    return kept.select("blob", one.alias("found")).groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))).alias("found"))


def joined_back(docs: DataFrame, found: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and found for every row; a blob's rows are dealt over SALT tasks, its findings repeated for each."""
    paths = docs.select(F.col(id_col).alias("doc_id"), F.sha2(text_or_empty(text_col), 256).alias("blob"), F.pmod(F.xxhash64(id_col), F.lit(SALT)).alias("salt"))
    repeated = found.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    none = F.array().cast(found.schema["found"].dataType)
    return paths.join(repeated, ["blob", "salt"], "left").select("doc_id", F.coalesce("found", none).alias("found"))


def digest_columns(found: Column) -> list[Column]:
    """n_assign, n_access, n_hex, base_sha256 and spans."""
    text = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter(found, lambda s: s["kind"].isin(*BASE))
    return [*map(of, BASE), F.sha2(text(base), 256).alias("base_sha256"), text(found).alias("spans")]


def masked(docs: DataFrame, found: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The rows with every found span of their text replaced by as many asterisks.

    Spans may overlap; a null text stays null, an empty one empty; copies and repeated rows are masked alike; columns may have any names; no rows give no rows.
    """
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.sha2(text_or_empty(text_col), 256).alias("blob"), F.pmod(F.xxhash64(text_col, F.monotonically_increasing_id()), F.lit(SALT)).alias("salt"))
    repeated = found.select("blob", "found").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    text, start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), F.col("row")[text_col]

    def step(state: Column, span: Column) -> Column:
        begin = F.greatest(state["at"], span["start"])
        end = F.greatest(begin, span["end"])
        return F.struct(F.concat(state["out"], F.substring(start, state["at"] + 1, begin - state["at"]), F.repeat(F.lit("*"), end - begin)).alias("out"), end.alias("at"))

    walked = F.aggregate("found", text, step, lambda s: F.concat(s["out"], F.substring(start, s["at"] + 1, F.length(start))))
    shown = F.when(F.col("found").isNull(), start).otherwise(walked).alias(text_col)
    return keyed.join(repeated, ["blob", "salt"], "left").select(*[shown if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The stored ledger; an empty one where nothing is stored yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(path)


def scan_into(docs: DataFrame, path: str, rules: tuple[Rule, ...] = RULES, *, text_col: str = "text") -> DataFrame:
    """Scan what the ledger stored at path lacks, append it there, and return the whole ledger.

    A run lost between scan and append scans again; a pair that two runs append at once is there twice, which findings and compacted bear.
    """
    spark = docs.sparkSession
    scan(docs, rules, read_ledger(spark, path), text_col=text_col).write.mode("append").parquet(path)
    return read_ledger(spark, path)


def compacted(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger's rows of the rules' current versions, each pair of blob and rule once; the caller writes them to a new path."""
    current = F.array(*[F.lit(f"{r.kind}@{r.version}") for r in rules])
    return ledger.filter(F.array_contains(current, F.concat_ws("@", "rule", F.col("version").cast("string")))).dropDuplicates(["blob", "rule", "version"])


def secret_scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> DataFrame:
    """For every row doc_id, the base counts, base_sha256 and spans (kind:start:end in code points).

    A null text is the empty blob and has no spans; very long texts are scanned whole; repeated rows and copies of a text
    get the same findings; ids may be null; other columns, whatever their names, are not looked at. With a ledger, only
    what it lacks is scanned. An empty table gives no rows.
    """
    new = scan(docs, rules, ledger)
    every = new if ledger is None else ledger.select("blob", "rule", "version", "spans").unionByName(new)
    return joined_back(docs, findings(every, rules)).select("doc_id", *digest_columns(F.col("found")))


#: Session setting with the path of a ledger that outlives the run, so that the next run scans only blobs and rule versions that are new.
LEDGER_PATH = "tallygraph.secrets.ledger"


def ledger_path(spark: SparkSession) -> str:
    """The path that the session names; without one a new path in the shared folder, which knows no blob yet."""
    return spark.conf.get(LEDGER_PATH, None) or fresh_path(spark, "ledger")


def op7_secret_scan(spark: SparkSession, sf_dir: str, ledger: str | None = None) -> DataFrame:
    """All documents: what the ledger (a path, or that of ledger_path) lacks is scanned into it, and findings are joined back to all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = findings(scan_into(docs, ledger or ledger_path(spark)))
    return joined_back(docs, found).select("doc_id", *digest_columns(F.col("found")))


def oracle() -> str:
    """The same rows in DuckDB: pieces between matches and matches give positions, as running sums."""
    either = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
    words = "|".join(map(either, ("password", "passwd", "secret", "token"))) + "|" + either("api") + "_?" + either("key")
    patterns = {r.kind: r.pattern.replace("(?i:password|passwd|secret|token|api_?key)", words) for r in RULES}
    ctes, unions = [], []
    for k, r in enumerate(RULES):
        p = patterns[r.kind].replace("'", "''")
        ok = f"length(regexp_extract(m, '{p}', {r.group})) >= {r.least}" if r.group else "true"
        ctes.append(f"""
m{k} AS (SELECT blob, text, unnest(regexp_extract_all(text, '{p}')) AS m, unnest(range(len(regexp_extract_all(text, '{p}')))) AS i FROM blobs),
g{k} AS (SELECT blob, length(unnest(regexp_split_to_array(text, '{p}'))) AS gap, unnest(range(len(regexp_split_to_array(text, '{p}')))) AS i
         FROM blobs WHERE blob IN (SELECT blob FROM m{k})),
s{k} AS (SELECT blob, m, i, sum(gap) OVER w + coalesce(sum(length(m)) OVER (PARTITION BY blob ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
         FROM m{k} JOIN g{k} USING (blob, i) WINDOW w AS (PARTITION BY blob ORDER BY i))""")
        unions.append(f"SELECT blob, CAST(start AS BIGINT) AS start, CAST(start + length(m) AS BIGINT) AS stop, {k} AS k, '{r.kind}' AS kind FROM s{k} WHERE {ok}")
    joined = "coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k){}, '')"
    count = lambda kind: f"CAST(count(*) FILTER (kind = '{kind}') AS BIGINT) AS n_{kind}"
    return f"""
WITH paths AS (SELECT doc_id, sha256(coalesce(text, '')) AS blob, coalesce(text, '') AS text FROM documents),
blobs AS (SELECT blob, any_value(text) AS text FROM paths GROUP BY blob), {",".join(ctes)},
found AS ({" UNION ALL ".join(unions)}),
by_blob AS (SELECT blob, {", ".join(map(count, BASE))}, {joined.format(f" FILTER (k < {len(BASE)})")} AS base, {joined.format("")} AS spans FROM found GROUP BY blob)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM paths LEFT JOIN by_blob USING (blob)"""
