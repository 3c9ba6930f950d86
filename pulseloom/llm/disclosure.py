"""Personal data and what reveals it, with DataFrame functions only.

Base spans (email, ip, card, phone) are leftmost matches that pass a check. The
method adds information-theoretic sanitisation: the values of base spans are the
protected entities; all other words of a text that holds one are terms. Over the
whole corpus the co-occurrence of term and entity and the frequency of every
word, all in distinct texts, give the pointwise mutual information. A term's disclosure of an
entity is PMI(t; e) / IC(e), 1 if the term determines the entity. Terms over the
threshold with enough support are spans too, wherever they stand.

A term is generalised to the class of words that begin alike (`[zo*]`) if that
class does not disclose an entity itself, by the same measure and counts; else it
is removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseloom.llm.common import stage, table

#: Kinds of base spans in their order. Patterns are those of the contract, written so that they never scan a run twice:
#: a match starts where a run starts or where the last match ended, and runs are not given back.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
WORDS = r"[^\p{L}]+"
MIN_LETTERS, CLASS_LETTERS = 3, 2
DISCLOSURE, SUPPORT = 0.9, 3


def located(text: Column, pattern: Column | str) -> Column:
    """array<struct<s, e, v>> of the leftmost matches, in code points: gaps and matches alternate, so lengths add up."""
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    both = F.arrays_zip(F.split(text, p, -1).alias("gap"), F.regexp_extract_all(text, p, F.lit(0)).alias("hit"))
    empty = F.expr("CAST(array() AS array<struct<s: int, e: int, v: string>>)")

    def add(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["gap"])
        e = s + F.coalesce(F.length(x["hit"]), F.lit(0))
        got = F.array(F.struct(s.alias("s"), e.alias("e"), x["hit"].alias("v")))
        return F.struct(e.alias("at"), F.when(x["hit"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], got)).alias("out"))

    return F.aggregate(both, F.struct(F.lit(0).alias("at"), empty.alias("out")), add, lambda a: a["out"])


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(acc: Column, i: Column) -> Column:
        d = back.substr(i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """Valid matches by kind; a cheap test comes before each search."""
    test = {
        "email": F.contains(text, F.lit("@")),
        "ip": text.rlike(r"[0-9]\.[0-9]"),
        "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"),
        "phone": text.rlike(r"\+[0-9]"),
    }
    valid = {
        "email": lambda x: F.lit(True),
        "ip": lambda x: x["v"].rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"),
        "card": lambda x: F.when(F.length(_digits(x["v"])).between(16, 19), luhn(_digits(x["v"]))).otherwise(F.lit(False)),
        "phone": lambda x: F.length(_digits(x["v"])).between(8, 15),
    }
    none = F.expr("CAST(array() AS array<struct<s: int, e: int, v: string>>)")
    return {k: F.when(test[k], F.filter(located(text, PATTERNS[k]), valid[k])).otherwise(none) for k in KINDS}


def _prepared(docs: DataFrame) -> DataFrame:
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return d.withColumn("mark", F.xxhash64("text"))


def words_around(text: Column) -> Column:
    """The distinct words of a text outside its base spans (only those of email hold letters), and the classes of their beginnings."""
    bare = F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, PATTERNS["email"], " ")).otherwise(text)
    words = F.filter(F.split(F.lower(bare), WORDS), lambda w: F.length(w) >= MIN_LETTERS)
    return F.array_distinct(F.concat(words, F.transform(words, word_class)))


def word_class(word: Column) -> Column:
    return F.concat(F.substring(word, 1, CLASS_LETTERS), F.lit("*"))


def revealing_terms(docs: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """Terms and classes of terms (with a `*`) over the threshold: term, entity (hash), support, disclosure."""
    found = docs.select("mark", words_around(F.col("text")).alias("words"), *[c.alias(k) for k, c in base_spans(F.col("text")).items()])
    named = lambda k: F.transform(k, lambda x: F.xxhash64(F.lit(k), F.lower(x["v"])))
    held = found.select("mark", "words", F.array_distinct(F.concat(*[named(k) for k in KINDS])).alias("entities")).where(F.size("entities") > 0)
    contexts = stage(held.dropDuplicates(["mark"]), "contexts")
    none = contexts.sparkSession.createDataFrame([], "term string, entity long, support long, disclosure double")
    if contexts.isEmpty():
        return none

    # The word "" stands once in every text, so its frequency is the number of texts.
    words = docs.dropDuplicates(["mark"]).select(F.explode(F.concat(F.array(F.lit("")), words_around(F.col("text")))).alias("term"))
    frequency = stage(words.groupBy("term").agg(F.count("*").alias("df")).where((F.col("df") >= support) | (F.col("term") == "")), "frequency")
    n = float(frequency.where("term = ''").first()["df"])

    # Support is at most ne, so the threshold bounds df; what is above can never reach it and need not be paired.
    entities = contexts.select("mark", F.explode("entities").alias("entity"))
    ne = entities.groupBy("entity").agg(F.count("*").alias("ne")).where(F.col("ne") >= support)
    ne = ne.withColumn("most", F.col("ne") * F.pow(F.lit(n) / F.col("ne"), F.lit(1.0 - disclosure)) * (1 + 1e-9))
    entities = stage(entities.join(ne, "entity"), "entities")
    limits = entities.groupBy("mark").agg(F.max("most").alias("limit"))
    terms = contexts.join(limits, "mark").select("mark", "limit", F.explode("words").alias("term"))
    terms = terms.join(frequency, "term").where(F.col("df") <= F.col("limit")).select("mark", "term", "df")
    pairs = terms.join(entities, "mark").where(F.col("df") <= F.col("most"))
    joint = pairs.groupBy("term", "entity", "df", "ne").agg(F.count("*").alias("support")).where(F.col("support") >= support)
    information = F.log2(F.lit(n) / F.col("ne"))
    told = F.when(information > 0, (F.log2(F.col("support") / F.col("df")) + information) / information)
    return joint.select("term", "entity", "support", told.alias("disclosure")).where(F.col("disclosure") >= disclosure)


def find_personal_data(docs: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT, redact: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term; `sanitised` too if `redact`.

    Spans are `kind:start:end` in code points, end exclusive, by kind (email, ip,
    card, phone, term) and start. Null text counts as empty and has no span (the
    digest is that of the empty text). Repeated rows give repeated results; a
    null id stays null; an empty table gives an empty result; extra columns are
    ignored. `sanitised` puts a label for base spans, generalises terms to their
    class or removes them; where
    spans overlap, the first kind at the leftmost start wins.
    """
    docs = _prepared(docs)
    over = stage(revealing_terms(docs, disclosure, support).select("term").distinct(), "over")
    is_class = F.endswith("term", F.lit("*"))
    closed = over.where(is_class).select(F.col("term").alias("class"), F.lit("").alias("closed"))
    terms = over.where(~is_class).withColumn("class", word_class(F.col("term"))).join(closed, "class", "left")
    # Staged, so that the planner knows its true size: a small table is broadcast to the words, only a large one costs their shuffle.
    terms = stage(terms.select("term", F.coalesce("closed", F.concat(F.lit("["), F.col("class"), F.lit("]"))).alias("put")), "terms")
    rows = docs
    if terms.isEmpty():
        rows = rows.withColumn("terms", F.lit(None).cast("array<string>")).withColumn("puts", F.lit(None).cast("map<string, string>"))
    else:
        own = docs.select("doc_id", "mark", F.explode(F.array_distinct(F.split(F.lower("text"), WORDS))).alias("term")).join(terms, "term")
        own = own.groupBy(F.col("doc_id").alias("id"), F.col("mark").alias("m")).agg(F.sort_array(F.collect_set(F.struct("term", "put"))).alias("found"))
        own = own.select("id", "m", F.transform("found", lambda x: x["term"]).alias("terms"), F.map_from_entries("found").alias("puts"))
        rows = rows.join(own, rows["doc_id"].eqNullSafe(own["id"]) & (rows["mark"] == own["m"]), "left").drop("id", "m")
    none = F.expr("CAST(array() AS array<struct<s: int, e: int, v: string>>)")
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join("terms", "|"), F.lit(r")(?!\p{L})"))
    spans = base_spans(F.col("text"))
    rows = rows.select("doc_id", "text", "puts", *[c.alias(k) for k, c in spans.items()], F.when(F.size("terms") > 0, located(F.col("text"), pattern)).otherwise(none).alias("term"))
    said = lambda k: F.transform(k, lambda x: F.concat(F.lit(f"{k}:"), x["s"], F.lit(":"), x["e"]))
    base = F.array_join(F.concat(*[said(k) for k in KINDS]), ",")
    every = F.array_join(F.concat(*[said(k) for k in (*KINDS, "term")]), ",")
    out = [F.col("doc_id"), *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(base.cast("binary"), 256).alias("base_sha256"), every.alias("spans"), F.size("term").cast("long").alias("n_term")]
    if redact:
        out.append(sanitised(F.col("text")).alias("sanitised"))
    return rows.select(*out)


def sanitised(text: Column) -> Column:
    """`text` with spans (columns named by kind) replaced by their labels, and terms by what the map `puts` has for them."""
    label = lambda k, x: F.lit(LABELS[k]) if k in LABELS else F.coalesce(F.try_element_at("puts", F.lower(x["v"])), F.lit(""))
    order = {k: i for i, k in enumerate((*KINDS, "term"))}
    tagged = lambda k: F.transform(k, lambda x: F.struct(x["s"].alias("s"), F.lit(order[k]).alias("o"), x["e"].alias("e"), label(k, x).alias("l")))
    every = F.array_sort(F.concat(*[tagged(k) for k in order]))

    def step(acc: Column, x: Column) -> Column:
        put = F.struct(x["e"].alias("at"), F.concat(acc["out"], text.substr(acc["at"] + 1, x["s"] - acc["at"]), x["l"]).alias("out"))
        return F.when(x["s"] >= acc["at"], put).otherwise(acc)

    return F.aggregate(every, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], text.substr(a["at"] + 1, F.length(text))))


def op3_disclosure_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"), redact=True)
