"""Queries on documents: parsing, classification, entities, facts, dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions import text as X
from tideline.functions.hashing import canonical_json, fnv1a
from tideline.operators import novelty as history
from tideline.session import table

#: Kinds of event by the first pattern that occurs (fixed values, in order).
EVENT_PATTERNS = [
    ("CORRECTION", (r"\bcorrection\b", r"\bcorrected\b")),
    ("RUMOR", (r"\brumou?r\b", r"\bunconfirmed\b")),
    ("EARNINGS_RELEASE", (r"\bearnings\b", r"\bquarterly results\b", r"\bnet income\b")),
    ("GUIDANCE_UPDATE", (r"\bguidance\b", r"\boutlook\b")),
    ("MERGER_ACQUISITION", (r"\bacqui(?:re[ds]?|sition)\b", r"\bmerger\b", r"\btakeover\b")),
    ("PRODUCT_RECALL", (r"\bproduct recall\b", r"\brecall(?:ed|s)?\b")),
    ("REGULATORY_ACTION", (r"\benforcement action\b", r"\bregulator\b", r"\bcivil penalty\b")),
    ("EXECUTIVE_CHANGE", (r"\bchief executive\b", r"\bceo\b.{0,48}\b(resign|appoint|depart)")),
    ("FINANCING", (r"\bfinancing\b", r"\bdebt offering\b", r"\bequity offering\b")),
    ("BANKRUPTCY", (r"\bbankruptcy\b", r"\bchapter 11\b", r"\binsolvency\b")),
    ("LITIGATION", (r"\blawsuit\b", r"\blitigation\b", r"\bsued\b")),
    ("CYBERSECURITY_INCIDENT", (r"\bcyber(?:security)? incident\b", r"\bdata breach\b", r"\bransomware\b")),
    ("ANALYST_ACTION", (r"\b(upgrade|downgrade)[ds]?\b", r"\bprice target\b")),
    ("SUPPLY_CHAIN_DISRUPTION", (r"\bsupply.chain disruption\b", r"\bshipment delay\b", r"\bshortage\b")),
    ("TRADING_HALT", (r"\btrading halt(?:ed)?\b", r"\bshares halted\b")),
    ("MACRO_RELEASE", (r"\bmacro release\b", r"\beconomic release\b", r"\bconsumer price index\b")),
]
EVENT_RULES = [("(?is)" + "|".join(patterns), label) for label, patterns in EVENT_PATTERNS]
#: Materiality in ppm by kind of event (fixed values).
MATERIALITY = {
    "EARNINGS_RELEASE": 750_000, "GUIDANCE_UPDATE": 800_000, "MERGER_ACQUISITION": 950_000, "PRODUCT_RECALL": 800_000, "REGULATORY_ACTION": 850_000, "EXECUTIVE_CHANGE": 650_000, "FINANCING": 650_000, "BANKRUPTCY": 1_000_000,
    "LITIGATION": 650_000, "CYBERSECURITY_INCIDENT": 850_000, "ANALYST_ACTION": 450_000, "SUPPLY_CHAIN_DISRUPTION": 700_000, "TRADING_HALT": 1_000_000, "MACRO_RELEASE": 800_000, "RUMOR": 250_000, "CORRECTION": 700_000,
}
#: Trust in ppm by state of authentication (fixed values).
TRUST = {"INVALID": 0, "MOCK_VERIFIED": 500_000, "REPLAY_HASH_VERIFIED": 650_000, "PUBLIC_TLS_VERIFIED": 850_000, "SIGNATURE_VERIFIED": 1_000_000}
PERCENT = r"([0-9]+(?:\.[0-9]+)?) ?%"
TICKER = r"\b([A-Z]{4,5})\b"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def form_counts(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).groupBy("document_type", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


def event_types(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where("text is not null").select("doc_id", X.first_marker("text", EVENT_RULES, "OTHER").alias("event_type"))


def rule_classification(spark: SparkSession, d: str) -> DataFrame:
    """Documents in English or of no known language with a kind of event: materiality, relevance (more with a stated percentage) and uncertainty (more with an instruction to the reader)."""
    kind = X.first_marker("text", EVENT_RULES, "OTHER")
    e = _docs(spark, d).where("text is not null and lang in ('en', 'und')").select("doc_id", "text", kind.alias("event_type")).where("event_type <> 'OTHER'")
    materiality = F.element_at(F.create_map(*(F.lit(x) for pair in MATERIALITY.items() for x in pair)), F.col("event_type"))
    return e.select("doc_id", "event_type", materiality.alias("materiality_ppm"), F.when(F.col("text").rlike(PERCENT), 850_000).otherwise(500_000).alias("relevance_ppm"), F.when(X.suspicious("text"), 700_000).otherwise(300_000).alias("uncertainty_ppm"))


def language_detect(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", X.language("text").alias("detected"))


def percent_facts(spark: SparkSession, d: str) -> DataFrame:
    """Percentages that a document states, one row each with its place."""
    return _docs(spark, d).select("doc_id", F.posexplode(X.facts("text", PERCENT)).alias("place", "value"))


def ticker_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Documents that name a known symbol: tokens joined with the universe, not text with every pattern."""
    universe = table(spark, d, "minute_readings").select(F.upper(F.trim("symbol")).alias("symbol")).distinct()
    tokens = _docs(spark, d).select("doc_id", F.explode(F.array_distinct(X.facts("text", TICKER))).alias("symbol"))
    return tokens.join(universe, "symbol").select("doc_id", "symbol")


def entity_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers' names under two spellings against an alias table: RESOLVED, AMBIGUOUS or REJECTED."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_name")
    spelled = s.select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.upper("s_name"), F.lit(", Inc."))).when(F.col("s_suppkey") % 3 == 1, F.regexp_replace("s_name", "#0+", " ")).otherwise(F.lit("nobody")).alias("asked"))
    aliases = s.select(F.explode(X.alias_keys("s_name")).alias("key"), F.col("s_suppkey").alias("candidate")).distinct()
    asked = spelled.select("s_suppkey", F.explode(X.alias_keys("asked")).alias("key"))
    g = asked.join(aliases, "key", "left").groupBy("s_suppkey").agg(F.countDistinct("candidate").alias("candidates"), F.min("candidate").alias("entity"))
    state = F.when(F.col("candidates") == 1, "RESOLVED").when(F.col("candidates") > 1, "AMBIGUOUS").otherwise("REJECTED")
    return g.select("s_suppkey", "candidates", state.alias("state"), F.when(F.col("candidates") == 1, F.col("entity")).alias("entity"))


def entity_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", X.entity_key(F.concat("p_name", F.lit(" /DE/ Co."))).alias("key"), F.array_join(X.alias_keys(F.concat("p_name", F.lit(" Co."))), ";").alias("aliases"))


def theme_lists(spark: SparkSession, d: str) -> DataFrame:
    """A theme list made from each event's fields, parsed: sorted distinct themes and organisations in order."""
    e = table(spark, d, "events").select("event_id", F.concat_ws(";", F.concat(F.col("event_type"), F.lit(",12")), F.lit("x y,3"), F.upper("event_type"), F.lit("ECON_RATE,7")).alias("v1"), F.concat_ws(";", F.lit("Bank of X,10"), F.concat(F.lit("Firm "), F.col("user_id"), F.lit(",20")), F.lit("")).alias("v2"))
    return e.select("event_id", F.array_join(X.themes("v1"), "|").alias("themes"), F.array_join(X.organisations("v2"), "|").alias("organisations"))


def source_urls(spark: SparkSession, d: str) -> DataFrame:
    """Normalised source addresses and the hosts' counts of documents."""
    s = table(spark, d, "source_documents").select(X.normal_url(F.concat(F.col("source_uri"), F.lit("?q=1#top"))).alias("url"))
    return s.groupBy(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host")).agg(F.count("url").alias("n"), F.countDistinct("url").alias("distinct_urls"))


def dedup_three_keys(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries judged in order: same key and content repeats, same key with other content conflicts, same content under another key is linked."""
    s = table(spark, d, "source_documents").select("provider_id", "document_id", F.sha2("payload", 256).alias("h"), F.col("received_wall_clock_utc_ns").alias("r")).where("r is not null")
    key = Window.partitionBy("provider_id", "document_id").orderBy("r")
    content = Window.partitionBy("h").orderBy("r", "provider_id", "document_id")
    s = s.withColumn("i", F.row_number().over(key)).withColumn("first_h", F.first("h").over(key)).withColumn("j", F.row_number().over(content))
    verdict = F.when((F.col("i") > 1) & (F.col("h") == F.col("first_h")), "DUPLICATE").when(F.col("i") > 1, "CONFLICT").when(F.col("j") > 1, "SAME_CONTENT").otherwise("NEW")
    return s.select(verdict.alias("verdict")).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def content_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The first document of each distinct text and how many carry it."""
    return _docs(spark, d).where("text is not null").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).select("doc_id", "copies")


def trust_scores(spark: SparkSession, d: str) -> DataFrame:
    """A fixed score by state of authentication, averaged per provider."""
    score = F.element_at(F.create_map(*(F.lit(x) for pair in TRUST.items() for x in pair)), F.col("authentication.status"))
    s = table(spark, d, "source_documents").select("provider_id", F.coalesce(score, F.lit(0)).cast("long").alias("score"))
    return s.groupBy("provider_id").agg(F.sum("score").alias("score_sum"), F.count(F.lit(1)).alias("n"))


def payload_scan(spark: SparkSession, d: str) -> DataFrame:
    """Payloads decoded by content type: characters, words and whether it is markup."""
    s = table(spark, d, "source_documents").withColumn("body", F.decode("payload", "UTF-8"))
    return s.groupBy("content_type").agg(F.count("body").alias("n"), F.sum(F.length("body")).alias("chars"), F.count_if(F.col("body").contains("</")).alias("markup"))


def redacted(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.concat(F.lit("url?api_key="), F.col("user_id"), F.lit("&x=1 Authorization: Bearer ab"), F.col("event_id")).alias("line"))
    return e.select("event_id", X.redact("line").alias("line"))


def option_symbols(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.concat(F.rpad(F.lit("ABC"), 6, " "), F.lit("2403"), F.lpad((F.col("p_partkey") % 28 + 1).cast("string"), 2, "0"), F.when(F.col("p_partkey") % 2 == 0, "C").otherwise("P"), F.lpad((F.col("p_partkey") * 500).cast("string"), 8, "0")).alias("s"))
    o = p.select("p_partkey", X.option_symbol("s").alias("o"))
    return o.select("p_partkey", "o.root", F.col("o.expiry").cast("string").alias("expiry"), "o.right", "o.strike_milli")


def instruction_flags(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.coalesce(X.suspicious("text"), F.lit(False)).alias("suspicious"))


def canonical_documents(spark: SparkSession, d: str) -> DataFrame:
    """Canonical JSON of the small fields, decoded again and hashed."""
    j = _docs(spark, d).select("doc_id", canonical_json("doc_id", "lang", "source").alias("j"))
    back = F.from_json("j", "doc_id bigint, lang string, source string")
    return j.select("doc_id", back.alias("r")).select("doc_id", F.col("r.lang").alias("lang"), F.col("r.source").alias("source"))


def visible_texts(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", X.visible_text("text").alias("visible"))


def stable_hashes(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", fnv1a("text").alias("fnv"))


def novelty(spark: SparkSession, d: str) -> DataFrame:
    """One minus the greatest word overlap with the last 4096 documents of all sources, in ppm."""
    return history.novelty(_docs(spark, d))


QUERIES = {
    f.__name__: f
    for f in (form_counts, event_types, rule_classification, language_detect, percent_facts, ticker_mentions, entity_resolution, entity_keys, theme_lists, source_urls, dedup_three_keys, content_dedup, trust_scores, payload_scan, redacted, option_symbols, instruction_flags, canonical_documents, visible_texts, stable_hashes, novelty)
}

_LEGAL = "|".join(X.LEGAL_FORMS)


def _key(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), '/[a-z]{{2,3}}/?', ' ', 'g'), '[^\\pL\\pN]+', ' ', 'g'), '\\s+', ' ', 'g'))"


def _aliases(x: str) -> str:
    return f"list_distinct([{_key(x)}, trim(regexp_replace({_key(x)}, '( ({_LEGAL}))+$', ''))])"


_LANG = {k: f"len(list_filter(w, lambda z: z in ({', '.join(repr(m) for m in v)})))" for k, v in X.MARKERS.items()}

SQL = {
    "form_counts": "select document_type, lang, count(*) as n, cast(sum(n_chars) as bigint) as chars from documents group by 1, 2",
    "rule_classification": "with k as (select doc_id, text, case " + " ".join(f"when regexp_matches(text, '{p}') then '{label}'" for p, label in EVENT_RULES) + " end as event_type from documents where text is not null and lang in ('en', 'und')) select doc_id, event_type, cast(case event_type "
    + " ".join(f"when '{k}' then {v}" for k, v in MATERIALITY.items())
    + f" end as integer) as materiality_ppm, cast(case when regexp_matches(text, '{PERCENT}') then 850000 else 500000 end as integer) as relevance_ppm, cast(case when regexp_matches(text, '{X.INSTRUCTIONS}') then 700000 else 300000 end as integer) as uncertainty_ppm from k where event_type is not null",
    "stable_hashes": """select doc_id, case when text is not null then cast(case when h >= 9223372036854775808 then cast(h as hugeint) - 18446744073709551616 else cast(h as hugeint) end as bigint) end as fnv from (
  select doc_id, text, list_reduce(list_prepend(cast(14695981039346656037 as uhugeint), list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda b: cast(cast('0x' || b as integer) as uhugeint))),
    lambda h, b: (xor(h, b) * cast(1099511628211 as uhugeint)) % cast(18446744073709551616 as uhugeint)) as h from documents)""",
    "event_types": "select doc_id, case " + " ".join(f"when regexp_matches(text, '{p}') then '{label}'" for p, label in EVENT_RULES) + " else 'OTHER' end as event_type from documents where text is not null",
    "language_detect": "with t as (select doc_id, regexp_split_to_array(lower(coalesce(text, '')), '[^\\pL]+') as w from documents), n as (select doc_id, "
    + ", ".join(f"{v} as {k}" for k, v in _LANG.items())
    + " from t) select doc_id, case when en >= 3 and en > greatest(es, fr) then 'en' when es >= 3 and es > greatest(en, fr) then 'es' when fr >= 3 and fr > greatest(en, es) then 'fr' else 'und' end as detected from n",
    "percent_facts": f"select doc_id, cast(p - 1 as integer) as place, v[p] as value from (select doc_id, v, unnest(range(1, len(v) + 1)) as p from (select doc_id, regexp_extract_all(coalesce(text, ''), '{PERCENT}', 1) as v from documents))",
    "ticker_mentions": f"select distinct doc_id, symbol from (select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '{TICKER}', 1)) as symbol from documents) semi join (select upper(trim(symbol)) as symbol from minute_readings) using (symbol)",
    "entity_resolution": f"""with s as (select s_suppkey, s_name, case when s_suppkey % 3 = 0 then upper(s_name) || ', Inc.' when s_suppkey % 3 = 1 then regexp_replace(s_name, '#0+', ' ') else 'nobody' end as asked from supplier),
a as (select distinct unnest({_aliases('s_name')}) as key, s_suppkey as candidate from s), q as (select s_suppkey, unnest({_aliases('asked')}) as key from s),
g as (select s_suppkey, count(distinct candidate) as candidates, min(candidate) as entity from q left join a using (key) group by 1)
select s_suppkey, candidates, case when candidates = 1 then 'RESOLVED' when candidates > 1 then 'AMBIGUOUS' else 'REJECTED' end as state, case when candidates = 1 then entity end as entity from g""",
    "entity_keys": f"""select p_partkey, {_key("p_name || ' /DE/ Co.'")} as key, case when {_key("p_name || ' Co.'")} = trim(regexp_replace({_key("p_name || ' Co.'")}, '( ({_LEGAL}))+$', '')) then {_key("p_name || ' Co.'")}
  else {_key("p_name || ' Co.'")} || ';' || trim(regexp_replace({_key("p_name || ' Co.'")}, '( ({_LEGAL}))+$', '')) end as aliases from part""",
    "theme_lists": "select event_id, array_to_string(list_sort(list_distinct([upper(event_type), 'ECON_RATE'])), '|') as themes, 'Bank of X|Firm ' || user_id as organisations from events",
    "source_urls": """with s as (select regexp_replace(source_uri, '[?#].*$', '') as u from source_documents), n as (select lower(regexp_extract(u, '^(https?://[^/]+)', 1)) || case when regexp_extract(u, '^https?://[^/]+(.*)$', 1) = '' then '/' else regexp_extract(u, '^https?://[^/]+(.*)$', 1) end as url from s)
select regexp_extract(url, '^https?://([^/]+)', 1) as host, count(url) as n, count(distinct url) as distinct_urls from n group by 1""",
    "dedup_three_keys": """with s as (select provider_id, document_id, sha256(payload) as h, received_wall_clock_utc_ns as r from source_documents where received_wall_clock_utc_ns is not null),
w as (select *, row_number() over k as i, first(h) over k as fh, row_number() over (partition by h order by r, provider_id, document_id) as j from s window k as (partition by provider_id, document_id order by r))
select case when i > 1 and h = fh then 'DUPLICATE' when i > 1 then 'CONFLICT' when j > 1 then 'SAME_CONTENT' else 'NEW' end as verdict, count(*) as n from w group by 1""",
    "content_dedup": "select min(doc_id) as doc_id, count(*) as copies from documents where text is not null group by text",
    "trust_scores": "select provider_id, cast(sum(case authentication.status when 'SIGNATURE_VERIFIED' then 1000000 when 'PUBLIC_TLS_VERIFIED' then 850000 when 'REPLAY_HASH_VERIFIED' then 650000 when 'MOCK_VERIFIED' then 500000 else 0 end) as bigint) as score_sum, count(*) as n from source_documents group by 1",
    "payload_scan": "select content_type, count(b) as n, cast(sum(length(b)) as bigint) as chars, count(*) filter (contains(b, '</')) as markup from (select content_type, decode(payload) as b from source_documents) group by 1",
    "redacted": "select event_id, 'url?api_key=[REDACTED]&x=1 Authorization: Bearer [REDACTED]' as line from events",
    "option_symbols": "select p_partkey, 'ABC' as root, cast(make_date(2024, 3, cast(p_partkey % 28 + 1 as integer)) as varchar) as expiry, case when p_partkey % 2 = 0 then 'C' else 'P' end as right, p_partkey * 500 as strike_milli from part",
    "instruction_flags": f"select doc_id, coalesce(regexp_matches(text, '{X.INSTRUCTIONS}'), false) as suspicious from documents",
    "canonical_documents": "select doc_id, lang, source from documents",
}
