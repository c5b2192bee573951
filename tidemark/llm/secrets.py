"""Operator 1: secret scans by trigram queries; DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass
from re import _parser as sre

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read


@dataclass(frozen=True)
class Rule:
    """A match counts if the given group has at least so many characters."""

    name: str
    regex: str
    group: int = 0
    least: int = 1


#: The rules in their listed order. Runs that are too short never match inside a longer one, so access and hex carry their length.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)


def literals(regex: str, most: int = 64) -> list[list[str]]:
    """Alternatives, each a list of strings that any match of it holds."""

    def walk(items) -> list[list[str]]:
        # an open string at the end of each alternative grows while literals follow
        done: list[list[str]] = [[""]]
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                done = [[*a[:-1], a[-1] + chr(arg)] for a in done]
            elif name in ("SUBPATTERN", "BRANCH"):
                options = [walk(arg[-1])] if name == "SUBPATTERN" else [walk(x) for x in arg[1]]
                done = [[*a[:-1], a[-1] + b[0], *b[1:]] for a in done for o in options for b in o]
            elif name == "MAX_REPEAT" and arg[0] == 0 and arg[1] == 1:
                done = [x for a in done for x in (a, *([*a[:-1], a[-1] + b[0], *b[1:]] for b in walk(arg[2])))]
            else:
                done = [[*a, ""] for a in done]
            if len(done) > most:
                return [[""]]
        return done

    return walk(sre.parse(regex))


def trigram_query(regex: str) -> list[set[str]]:
    """Alternatives of lower-case trigrams that must all occur; an empty list: the rule scans fully."""
    out = [{s.lower()[k : k + 3] for s in a for k in range(len(s) - 2)} for a in literals(regex)]
    return [] if any(not a for a in out) else out


#: Matches of a text are numbered in chunks of so many, which keeps the cost of a text full of matches linear.
CHUNK = 64


def spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """Array of (start, rank, kind, end), code points, of the matches that count."""
    found, gaps = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0)), F.split(text, rule.regex, -1)
    value = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group))
    size = lambda c: F.transform(c, lambda x: F.char_length(x))
    lengths = F.arrays_zip(size(gaps).alias("gap"), size(found).alias("hit"), size(value).alias("value"))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(found)) / CHUNK).cast("int")), lambda k: F.slice(lengths, k * CHUNK + 1, F.lit(CHUNK)))
    whole = lambda x: x["gap"] + F.coalesce(x["hit"], F.lit(0))
    # the place where each chunk begins, then the places within it
    starts = F.aggregate(
        F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda t, x: t + whole(x))),
        F.array(F.lit(0)),
        lambda t, n: F.concat(t, F.array(F.element_at(t, -1) + n)),
    )
    empty = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    span = lambda at, x: F.struct((at + x["gap"]).alias("start"), F.lit(rank).alias("rank"), F.lit(rule.name).alias("kind"), (at + whole(x)).alias("end"))
    step = lambda t, x: F.struct(
        (t["at"] + whole(x)).alias("at"),
        F.when(F.coalesce(x["value"], F.lit(0)) >= rule.least, F.concat(t["out"], F.array(span(t["at"], x)))).otherwise(t["out"]).alias("out"),
    )
    parts = F.zip_with(chunks, starts, lambda c, at: F.when(c.isNotNull(), F.aggregate(c, F.struct(at.alias("at"), empty.alias("out")), step, lambda t: t["out"])))
    return F.flatten(F.array_compact(parts))


def postings(texts: DataFrame, wanted: set[str]) -> DataFrame:
    """(trigram, digest): the inverted index of texts (digest, body) over the trigrams that rules ask for.

    Texts are indexed by their digest, so that copies of a text share its postings.
    """
    low = F.lower("body")
    held = F.filter(F.array(*[F.lit(t) for t in sorted(wanted)]), lambda t: F.contains(low, t))
    return texts.select("digest", F.explode(held).alias("trigram")).distinct()


#: Rows of one text are joined with its candidates in so many parts, by their key.
PARTS = 16


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Adds secrets: array<struct<start, rank, kind, end>> by start, then rule; a column of that name is replaced.

    Null text: no spans. A rule's Boolean query (alternatives of trigrams) is evaluated by intersecting postings: a
    text is a candidate if, for one alternative, it stands in the postings of each of its trigrams. Only candidates
    are verified by the regex. A rule without mandatory trigrams reads every text.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), body.alias("body"), F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int").alias("part")).withColumn("digest", F.md5(F.col("body").cast("binary")))
    asked = [(k, n, t, len(a)) for k, r in enumerate(rules) for n, a in enumerate(trigram_query(r.regex)) for t in sorted(a)]
    rows = rows.withColumn("hits", F.lit(None).cast("array<int>"))
    if asked:
        # as small as the rules
        query = F.broadcast(spark.createDataFrame(asked, "rule int, alternative int, trigram string, need int"))
        index = postings(rows.select("digest", "body"), {t for _, _, t, _ in asked})
        whole = index.join(query, "trigram").groupBy("digest", "rule", "alternative", "need").agg(F.count(F.lit(1)).alias("held")).where("held = need")
        candidates = whole.groupBy("digest").agg(F.collect_set("rule").alias("hits"))
        spread = candidates.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        rows = rows.drop("hits").join(spread, ["digest", "part"], "left")
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    parts = []
    for k, r in enumerate(rules):
        asks = F.array_contains(F.coalesce("hits", F.array().cast("array<int>")), F.lit(k)) if any(a[0] == k for a in asked) else F.col("body").rlike(r.regex)
        parts.append(F.when(asks, spans_of(F.col("body"), r, k)).otherwise(none))
    return rows.select(*[F.col(f"row.`{c}`") for c in docs.columns if c != "secrets"], F.array_sort(F.concat(*parts)).alias("secrets"))


def digest(found: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    line = F.array_join(F.transform("secrets", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *[count(r.name) for r in RULES], F.sha2(line.cast("binary"), 256).alias("base_sha256"), line.alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan(read(spark, sf_dir, "documents").select("doc_id", "text")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks each secret in the text; every document stays, and every column, one named secrets too."""
    found = scan(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("text"), F.col("doc_id")))
    body, marks = F.coalesce("text", F.lit("")), F.col("secrets")
    # what stands before each span, and after the last; spans that overlap are one
    ends = F.transform(marks, lambda m: m["end"])
    kept = F.transform(marks, lambda m, k: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.when(k > 0, F.array_max(F.slice(ends, 1, k))).otherwise(0).alias("at")))
    pieces = F.transform(kept, lambda m: F.when(m["start"] >= m["at"], F.concat(F.substring(body, m["at"] + 1, m["start"] - m["at"]), F.lit("[SECRET]"))).otherwise(""))
    masked = F.concat(F.array_join(pieces, ""), F.substring(body, F.array_max(ends) + 1, F.char_length(body)))
    out = F.when(F.size(marks) > 0, masked).otherwise(F.col("text"))
    made = found.select("doc", out.alias("masked"), (F.size(marks) > 0).alias("changed"))
    column = lambda c: F.col("masked") if c == "text" else F.when(F.col("changed"), F.char_length("masked").cast("long")).otherwise(F.col("doc.n_chars")) if c == "n_chars" else F.col(f"doc.`{c}`")
    return made.select(*[column(c).alias(c) for c in docs.columns])
