"""Inputs of the catalog's queries, made from the given relational tables: each in Spark, and as SQL that makes the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CODES = ("CN", "US", "RU", "HK", "KY", "US", "GB", "", "DE", "US", "IR", "SG")
FORMS = {"1-URGENT": "10-K", "2-HIGH": "20-F", "3-MEDIUM": "8-K", "4-NOT SPECIFIED": "10-Q", "5-LOW": "10-K/A"}
TOKENS = ("Shanghai", "Gazprom", "Nominee", "Indiana", "Procter", "Delaware", "Plain", "Temasek", "Minister", "Hainan Sinopec", "CURACAO", "Roman")
SUFFIXES = ("Holdings Inc", "Capital Partners LP", "Co., Ltd.", "LLC", "Group", "")
TIERS = ("ADVERSARIAL", "CONDUIT", "OPACITY", "MONITORED", "STANDARD")
PLACES = ("China", "Hong Kong", "Bermuda", "Qatar", "France")
RELATIONS = ("person_role", "institution_role", "beneficial_owner", "country_association", "incorporated_in", "consolidated_subsidiary")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values, index: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), index.cast("int"))


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A submission index: orders are filings of customers; registrant k lists 2k + 1, 2k + 2 and, every seventh, k / 3."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    k, n = F.col("o_custkey"), F.col("c_nationkey")
    form = F.create_map(*[F.lit(x) for p in FORMS.items() for x in p])
    code = lambda i: _pick(CODES, F.pmod(n + i + F.pmod(F.col("o_orderkey"), F.lit(3)), F.lit(len(CODES))))
    listed = F.concat_ws(" ", (2 * k + 1).cast("string"), (2 * k + 2).cast("string"), F.when(F.pmod(k, F.lit(7)) == 0, F.floor(k / 3).cast("string")), k.cast("string"))
    return rows.select(
        F.col("o_orderkey").cast("string").alias("adsh"), k.cast("string").alias("cik"), F.col("c_name").alias("name"), (1000 + F.pmod(k, F.lit(8000))).cast("string").alias("sic"), code(0).alias("countryba"), code(5).alias("countryinc"),
        code(1).alias("countryma"), F.when(F.pmod(k, F.lit(5)) == 0, F.concat(F.lit("Old Widget "), k.cast("string"))).otherwise("").alias("former"), F.element_at(form, F.col("o_orderpriority")).alias("form"),
        F.date_format("o_orderdate", "yyyyMMdd").alias("filed"), F.when(F.pmod(F.col("o_orderkey"), F.lit(4)) == 0, listed).otherwise("").alias("aciks"), F.date_format("o_orderdate", "yyyy").alias("source_period"), F.col("o_orderkey").alias("seq"),
    )


_code = lambda i: f"{_sql_list(CODES)}[(c_nationkey + {i} + o_orderkey % 3) % {len(CODES)} + 1]"
SUB = f"""sub AS (SELECT o_orderkey::VARCHAR AS adsh, o_custkey::VARCHAR AS cik, c_name AS name, (1000 + o_custkey % 8000)::VARCHAR AS sic, {_code(0)} AS countryba, {_code(5)} AS countryinc, {_code(1)} AS countryma,
    CASE WHEN o_custkey % 5 = 0 THEN 'Old Widget ' || o_custkey ELSE '' END AS former, CASE o_orderpriority {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in FORMS.items())} END AS form, strftime(o_orderdate, '%Y%m%d') AS filed,
    CASE WHEN o_orderkey % 4 = 0 THEN concat_ws(' ', 2 * o_custkey + 1, 2 * o_custkey + 2, CASE WHEN o_custkey % 7 = 0 THEN o_custkey // 3 END, o_custkey) ELSE '' END AS aciks, strftime(o_orderdate, '%Y') AS source_period, o_orderkey AS seq
    FROM orders JOIN customer ON o_custkey = c_custkey)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from suppliers to parts; a line's numbers choose relationship, tiers, flags and notes. Many keys repeat, some with new notes."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    s, p, n = F.col("l_suppkey"), F.col("l_partkey"), F.col("l_linenumber")
    tier = lambda c: _pick(TIERS, F.pmod(c, F.lit(5)))
    place = lambda c: F.when(F.pmod(c, F.lit(4)) > 0, _pick(PLACES, F.pmod(c, F.lit(5))))
    flag = lambda k: F.pmod(p + n, F.lit(k)) == 0
    return rows.select(
        F.col("s_name").alias("source"), F.lit("company").alias("source_type"), F.concat(F.lit("Part "), F.pmod(p, F.lit(40)).cast("string")).alias("target"), F.when(F.pmod(p, F.lit(2)) == 0, "person").otherwise("company").alias("target_type"),
        place(s).alias("source_jurisdiction"), tier(s).alias("source_risk_tier"), place(p + n).alias("target_jurisdiction"), tier(p + n).alias("target_risk_tier"), _pick(RELATIONS, F.pmod(n, F.lit(6))).alias("relationship"), F.col("l_returnflag").alias("detail"),
        F.when(F.pmod(p + n, F.lit(9)) == 0, "SOE").alias("state_affiliation"), F.lit(None).cast("string").alias("state_affiliation_sub"), F.lit(None).cast("string").alias("state_affiliation_detail"),
        flag(3).alias("role_is_executive"), flag(4).alias("role_is_board"), flag(5).alias("role_is_ownership"), flag(7).alias("role_is_obscuring"), n.cast("int").alias("chain_depth"), F.pmod(F.col("l_orderkey"), F.lit(50)).cast("string").alias("filing_accession"),
        F.lit("10-K").alias("filing_form"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("filing_date"), F.lit("m").alias("method"),
        F.when(F.pmod(p, F.lit(11)) == 0, None).otherwise(F.concat(F.lit("note "), F.pmod(p, F.lit(6)).cast("string"), F.lit("; SIC: "), (1000 + F.pmod(p, F.lit(8000))).cast("string"))).alias("notes"),
        F.concat(F.lit("CIK: "), s.cast("string")).alias("source_notes"), F.lit(None).cast("string").alias("target_notes"), ((F.col("l_orderkey") * 10 + n) * 1000000 + p).alias("seq"),
    )


_place = lambda c: f"CASE WHEN ({c}) % 4 > 0 THEN {_sql_list(PLACES)}[({c}) % 5 + 1] END"
_tier = lambda c: f"{_sql_list(TIERS)}[({c}) % 5 + 1]"
EDGES = f"""edges AS (SELECT s_name AS source, 'company' AS source_type, 'Part ' || (l_partkey % 40) AS target, CASE WHEN l_partkey % 2 = 0 THEN 'person' ELSE 'company' END AS target_type,
    {_place("l_suppkey")} AS source_jurisdiction, {_tier("l_suppkey")} AS source_risk_tier, {_place("l_partkey + l_linenumber")} AS target_jurisdiction, {_tier("l_partkey + l_linenumber")} AS target_risk_tier,
    {_sql_list(RELATIONS)}[l_linenumber % 6 + 1] AS relationship, l_returnflag AS detail, CASE WHEN (l_partkey + l_linenumber) % 9 = 0 THEN 'SOE' END AS state_affiliation,
    (l_partkey + l_linenumber) % 3 = 0 AS role_is_executive, (l_partkey + l_linenumber) % 4 = 0 AS role_is_board, (l_partkey + l_linenumber) % 5 = 0 AS role_is_ownership, (l_partkey + l_linenumber) % 7 = 0 AS role_is_obscuring,
    l_linenumber::INT AS chain_depth, (l_orderkey % 50)::VARCHAR AS filing_accession, strftime(l_shipdate, '%Y-%m-%d') AS filing_date,
    CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE 'note ' || (l_partkey % 6) || '; SIC: ' || (1000 + l_partkey % 8000) END AS notes, 'CIK: ' || l_suppkey AS source_notes, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS seq
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that hold tokens of jurisdictions, affiliations and suffixes, for every part."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("key"), F.concat(_pick(TOKENS, F.pmod(k, F.lit(len(TOKENS)))), F.lit(" "), F.col("p_name"), F.lit(" "), _pick(SUFFIXES, F.pmod(k, F.lit(len(SUFFIXES))))).alias("name"), F.when(F.pmod(k, F.lit(3)) > 0, _pick(PLACES, F.pmod(k, F.lit(5)))).alias("country"))


NAMES = f"names AS (SELECT p_partkey AS key, {_sql_list(TOKENS)}[p_partkey % {len(TOKENS)} + 1] || ' ' || p_name || ' ' || {_sql_list(SUFFIXES)}[p_partkey % {len(SUFFIXES)} + 1] AS name, CASE WHEN p_partkey % 3 > 0 THEN {_sql_list(PLACES)}[p_partkey % 5 + 1] END AS country FROM part)"


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings with markup, header numbers, sections, signatures, owners and subsidiaries; one for each order.

    Orders are some bytes each and a file of them few tasks, so they are dealt to all tasks before texts are made of them.
    """
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_custkey", "o_orderstatus", "c_name")
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")
    k = F.col("o_custkey").cast("string")
    place = _pick(("China", "Hong Kong", "Bermuda", "Qatar", "U.S."), F.pmod(F.col("o_orderkey"), F.lit(5)))
    parts = [
        "CENTRAL INDEX KEY: 00", (100000 + F.col("o_custkey")).cast("string"), "\r\n<P>Report of  ", F.col("c_name"), "</P><b>in</b>\t", place, "<br/>See /CIK000", (200000 + F.col("o_custkey")).cast("string"), ".json and CIK # ", (F.col("o_orderkey") + 1000).cast("string"),
        "\n\n\n\nMANAGEMENT\nJohn Q. Public, age 52, Director, and Mary Roe, President, of Acme ", F.col("o_orderstatus"), " Capital Partners LLC\nNAME OF REPORTING PERSON\nAlpha Fund ", k, " LP\nPERCENT OF CLASS: ", F.pmod(F.col("o_custkey"), F.lit(60)).cast("string"),
        ".5%\nTITLE OF CLASS OF SECURITIES: Common Stock\n\n SIGNATURES \n/s/ Jane Doe\nBy: Richard Miles\nEXHIBIT 21\n",
    ]
    return rows.select(F.col("o_orderkey").alias("key"), F.col("o_custkey").cast("string").alias("cik"), F.concat(F.lpad((300000 + F.col("o_custkey")).cast("string"), 10, "0"), F.lit("-24-"), F.lpad(F.pmod(F.col("o_orderkey"), F.lit(999999)).cast("string"), 6, "0")).alias("accession"), F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in parts]).alias("content"))


FILINGS = """filings AS (SELECT o_orderkey AS key, o_custkey::VARCHAR AS cik, lpad((300000 + o_custkey)::VARCHAR, 10, '0') || '-24-' || lpad((o_orderkey % 999999)::VARCHAR, 6, '0') AS accession,
    concat('CENTRAL INDEX KEY: 00', 100000 + o_custkey, chr(13), chr(10), '<P>Report of  ', c_name, '</P><b>in</b>', chr(9), ['China', 'Hong Kong', 'Bermuda', 'Qatar', 'U.S.'][o_orderkey % 5 + 1], '<br/>See /CIK000', 200000 + o_custkey, '.json and CIK # ', o_orderkey + 1000,
    repeat(chr(10), 4), 'MANAGEMENT', chr(10), 'John Q. Public, age 52, Director, and Mary Roe, President, of Acme ', o_orderstatus, ' Capital Partners LLC', chr(10), 'NAME OF REPORTING PERSON', chr(10), 'Alpha Fund ', o_custkey, ' LP', chr(10), 'PERCENT OF CLASS: ', o_custkey % 60,
    '.5%', chr(10), 'TITLE OF CLASS OF SECURITIES: Common Stock', chr(10), chr(10), ' SIGNATURES ', chr(10), '/s/ Jane Doe', chr(10), 'By: Richard Miles', chr(10), 'EXHIBIT 21', chr(10)) AS content
    FROM orders JOIN customer ON o_custkey = c_custkey)"""
#: The text of `filings` without markup and in order, in SQL.
PLAIN = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, '(?i)<\s*br\s*/?\s*>', chr(10), 'g'), '(?i)<\s*/?\s*p[^>]*>', chr(10), 'g'), '<[^>]+>', '', 'g'), '\r\n?', chr(10), 'g'), '[^\x09\x0A\x20-\x7E]', ' ', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land holdings with column names as in a published table."""
    p = F.col("l_partkey")
    return table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.concat(_pick(("CHINA", " P.R.C ", "Canada", "prc", "Hong Kong"), F.pmod(p, F.lit(5)))).alias("Country"), F.concat(F.col("s_name"), _pick((", LLC", " INC", "", " CORP."), F.pmod(F.col("l_suppkey"), F.lit(4)))).alias("Owner Name 1/"),
        _pick(("TX", "IA", "DE"), F.pmod(p, F.lit(3))).alias("State"), F.concat(F.lit("County "), F.pmod(p, F.lit(9)).cast("string")).alias("County"), F.concat((F.pmod(p, F.lit(30)) * 37).cast("string"), F.lit(".0")).alias("FIPS"),
        F.concat(F.lit("$"), F.col("l_quantity").cast("int").cast("string"), F.lit(" ac")).alias("Number of Acres"), F.when(F.pmod(p, F.lit(7)) == 0, "1").otherwise("").alias("Secondary Interest in China"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000000 + p).alias("seq"),
    )


HOLDINGS = """holdings AS (SELECT ['CHINA', ' P.R.C ', 'Canada', 'prc', 'Hong Kong'][l_partkey % 5 + 1] AS country, s_name || [', LLC', ' INC', '', ' CORP.'][l_suppkey % 4 + 1] AS entity_name, ['TX', 'IA', 'DE'][l_partkey % 3 + 1] AS state, 'County ' || (l_partkey % 9) AS county,
    lpad((l_partkey % 30 * 37)::VARCHAR, 5, '0') AS fips, l_quantity::INT::DOUBLE AS acres, l_partkey % 7 = 0 AS secondary_china, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS seq FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""
