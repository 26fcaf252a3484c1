"""Licence scan by canonical digests (native: DataFrame functions only).

A text's canonical form: lower case, copyright lines dropped, equivalent spellings made one, everything but letters and
digits turned into single blanks. Whole texts are matched by hash join with the digests of known
licence texts; a text's lines and paragraphs are texts of their own, so that a notice inside a document is found by
the same join. So are runs of as many paragraphs as a known text has, which begin where a paragraph's digest joins that of a known text's first one. The known
digests come from the same expressions and are a few hundred rows.

Only texts that hold one of the words which every known text has are taken apart; what their digests meet goes back to the rows by the text's hashes.

Edge cases: null and empty texts have the digest of the empty form and match nothing; repeated rows are
scanned one by one; licences that share a text all count, in order of name, joined by a comma; a very long text is one row of the scan, and its lines rows
of their own; an empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verisift.llm.common import drop_staged, small_side, staged, table, text_keys
from verisift.llm.license_texts import whole_texts

#: Lines that say who holds the copyright: with a sign, a year or "by", so that prose on copyright stays.
COPYRIGHT = r"(?m)^[^a-z0-9\n]*(copyright *(\(c\)|©|by )|copyright[^a-z0-9\n]*([0-9]{4}|year|yyyy|<|\[)|(©|\(c\)) *[0-9]{4}|all rights reserved)[^\n]*$"
#: Equivalent spellings, in the canonical form with blanks around words.
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("https", "http"), ("noninfringement", "non infringement"),
    ("acknowledgement", "acknowledgment"), ("organisation", "organization"), ("favour", "favor"), ("merchantibility", "merchantability"), ("centre", "center"), ("programme", "program"),
    ("authorise", "authorize"), ("authorised", "authorized"), ("initialise", "initialize"), ("judgement", "judgment"), ("recognise", "recognize"), ("wilful", "willful"), ("copyright holders", "copyright holder"),
)


def _without_copyright(low: Column) -> Column:
    # Most texts have no such word: they skip the costlier pattern.
    return F.when(F.rlike(low, F.lit(r"copyright|©|\(c\)|all rights")), F.regexp_replace(low, COPYRIGHT, " ")).otherwise(low)


def _words(low: Column) -> Column:
    return F.trim(F.regexp_replace(low, r"[^\p{L}\p{N}]+", " "))


def _spelled(words: Column) -> Column:
    spelled = F.concat(F.lit(" "), words, F.lit(" "))
    for a, b in SPELLINGS:
        spelled = F.replace(spelled, F.lit(f" {a} "), F.lit(f" {b} "))
    hint = "|".join(a.split()[0] for a, _ in SPELLINGS)
    return F.when(F.rlike(words, F.lit(hint)), F.trim(spelled)).otherwise(words)


def canonical(text: Column) -> Column:
    """The canonical form of a text; empty if nothing is left."""
    return _spelled(_words(_without_copyright(F.lower(F.coalesce(text, F.lit(""))))))


def with_canonical(docs: DataFrame, text: str, name: str) -> DataFrame:
    """docs with the canonical form of a column, step by step: each step reads its input several times and is computed once."""
    x = docs.withColumn(name, F.lower(F.coalesce(text, F.lit(""))))
    for step in (_without_copyright, _words, _spelled):
        x = x.withColumn(name, step(F.col(name)))
    return x


def paragraphs(text: Column) -> Column:
    """Canonical forms of a text's paragraphs without the empty ones (those of copyright lines, say)."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n"), canonical), lambda x: x != "")


#: Every known text holds one of these, and so does each line or paragraph that is one.
HINT = r"(?i)licen[sc]e|permission|redistribut"


def known(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(digest, names) of the known texts, and (first, sizes): the digest of the first paragraph and the numbers of paragraphs of those that have several.
    A few hundred rows, whatever the documents."""
    rows = spark.createDataFrame(whole_texts(), "license string, text string").withColumn("p", paragraphs(F.col("text")))
    rows = rows.select(F.sha2(canonical(F.col("text")), 256).alias("digest"), "license", F.sha2(F.get("p", F.lit(0)), 256).alias("first"), F.size("p").alias("n"))
    names = rows.groupBy("digest").agg(F.array_sort(F.collect_set("license")).alias("names"))
    return names, rows.where("n > 1").groupBy("first").agg(F.collect_set("n").alias("sizes"))


def telling(docs: DataFrame) -> DataFrame:
    """k1, k2 (hashes of the text) and t of the rows whose text holds a word of HINT, told by plain search in lower case."""
    low = F.lower("text")
    has = F.contains(low, F.lit("license")) | F.contains(low, F.lit("licence")) | F.contains(low, F.lit("permission")) | F.contains(low, F.lit("redistribut"))
    return docs.where(has).select(*text_keys(F.col("text")), F.col("text").alias("t"))


def notices(told: DataFrame, names: DataFrame, begins: DataFrame) -> DataFrame:
    """k1, k2 and notices of the texts (telling()) that hold any."""
    parts = F.filter(F.concat(F.split("t", r"\n"), F.split("t", r"\n\s*\n")), lambda x: F.rlike(x, F.lit(HINT)))
    single = told.select("k1", "k2", F.explode(F.array_distinct(parts)).alias("x")).select("k1", "k2", F.sha2(canonical(F.col("x")), 256).alias("digest"))
    split = told.select("k1", "k2", paragraphs(F.col("t")).alias("p")).select("k1", "k2", "p", F.posexplode("p").alias("i", "x"))
    runs = split.withColumn("first", F.sha2("x", 256)).join(F.broadcast(begins), "first").select("k1", "k2", "p", "i", F.explode("sizes").alias("n"))
    runs = runs.select("k1", "k2", F.sha2(F.array_join(F.slice("p", F.col("i") + 1, F.col("n")), " "), 256).alias("digest"))
    found = single.unionByName(runs).join(F.broadcast(names), "digest").select("k1", "k2", F.explode("names").alias("name"))
    return found.groupBy("k1", "k2").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("notices"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, digest, license (of the whole text, null if unknown), notices (licences that lines, paragraphs or
    runs of paragraphs of the text are, in order of name, joined by a comma; empty if none)."""
    names, begins = (staged(x, "license-catalogue") for x in known(docs.sparkSession))
    told = staged(telling(docs), "license-texts")  # read twice, and few
    found = staged(notices(told, names, begins), "license-notices")
    drop_staged(told)
    rows = with_canonical(docs.select("doc_id", "text", *text_keys(F.coalesce("text", F.lit("")))), "text", "form")
    rows = rows.select("doc_id", "k1", "k2", F.sha2("form", 256).alias("digest"))
    # The join proper: digests of whole texts with the known ones.
    whole = rows.join(F.broadcast(names), "digest", "left").join(small_side(found), ["k1", "k2"], "left")
    return whole.select("doc_id", "digest", F.array_join("names", ",").alias("license"), F.coalesce("notices", F.lit("")).alias("notices"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    def form(x: str) -> str:
        t = f"trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '{COPYRIGHT.replace('(?m)', '(?m)')}', ' ', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
        s = f"' ' || {t} || ' '"
        for a, b in SPELLINGS:
            s = f"replace({s}, ' {a} ', ' {b} ')"
        return f"trim({s})"

    quote = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({quote(k)}, {quote(t)})" for k, t in whole_texts())
    parts = lambda x: f"list_filter(list_transform(regexp_split_to_array(coalesce({x}, ''), '\\n\\s*\\n'), lambda y: {form('y')}), lambda y: y <> '')"
    return f"""
WITH v(license, text) AS (VALUES {values}),
w AS (SELECT license, {form('text')} AS whole, {parts('text')} AS p FROM v),
k AS (SELECT sha256(whole) AS digest, string_agg(DISTINCT license, ',' ORDER BY license) AS names FROM w GROUP BY 1),
s AS (SELECT DISTINCT p[1] AS first, len(p) AS n FROM w WHERE len(p) > 1),
d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
p AS (SELECT rid, unnest(string_split(text, chr(10))) AS x FROM d UNION ALL SELECT rid, unnest(regexp_split_to_array(text, '\\n\\s*\\n')) FROM d WHERE regexp_matches(text, '{HINT}')),
q AS (SELECT rid, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT rid, {parts('text')} AS p FROM d WHERE regexp_matches(text, '{HINT}'))),
f AS (SELECT rid, sha256({form('x')}) AS digest FROM p WHERE regexp_matches(x, '{HINT}') UNION ALL SELECT rid, sha256(array_to_string(p[i:i + n - 1], ' ')) FROM q JOIN s ON s.first = p[i]),
n AS (SELECT rid, string_agg(DISTINCT name, ',' ORDER BY name) AS notices FROM (SELECT rid, unnest(string_split(names, ',')) AS name FROM f JOIN k USING (digest)) GROUP BY rid)
SELECT doc_id, sha256({form('text')}) AS digest, names AS license, coalesce(notices, '') AS notices
FROM d LEFT JOIN n USING (rid) LEFT JOIN k ON k.digest = sha256({form('text')})"""


SQL = _sql()
