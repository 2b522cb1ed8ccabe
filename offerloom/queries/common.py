"""Shared pieces of the queries: table access, sample offers built from rows, SQL snippets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom import fixed

SPACE = fixed.SPACE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame) -> DataFrame:
    """Rows dealt evenly over all cores, for a table whose few files or row groups hold rows that cost much more time than bytes."""
    spark = rows.sparkSession
    return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


#: Bytes of a stored table that one slice of a job takes, and the slices there are at most, as each reads the table anew.
SLICE_BYTES, SLICES = 256 << 20, 6


def slices_of(rows: DataFrame) -> int:
    """The slices in which a job on a stored table is done, by the size of its files."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(1, min(SLICES, -(-size // SLICE_BYTES)))


def quoted(words) -> str:
    """Words as a SQL list of literals."""
    return ", ".join("'" + word.replace("'", "''") + "'" for word in words)


# -- an offer text per line item ----------------------------------------------------------------


def offer_text() -> Column:
    """Offer wording made of a line item; seven forms by line number."""
    percent = F.round(F.col("l_discount") * 100).cast("int").cast("string")
    quantity = F.col("l_quantity").cast("int").cast("string")
    part, supplier = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    return (
        F.when(F.col("l_linenumber") == 1, F.concat(percent, F.lit("% off item "), part, F.lit(" today")))
        .when(
            F.col("l_linenumber") == 2,
            F.concat(F.lit("£"), quantity, F.lit(" off when you spend at least £"), supplier, F.lit(" here")),
        )
        .when(
            F.col("l_linenumber") == 3,
            F.concat(F.lit("<b>Free  delivery</b> on item "), part, F.lit(" now")),
        )
        .when(F.col("l_linenumber") == 4, F.concat(F.lit("Buy "), quantity, F.lit(" get 1 free today")))
        .when(
            F.col("l_linenumber") == 5,
            F.concat(F.lit("Extra  discount, min spend of £"), supplier, F.lit(".50 applies")),
        )
        .when(
            F.col("l_linenumber") == 6,
            F.concat(percent, F.lit(".5% OFF plus £"), quantity, F.lit(" back today")),
        )
        .otherwise(F.concat(F.lit("Sponsored: "), percent, F.lit("% off")))
    )


OFFER_TEXT_SQL = """
CASE l_linenumber
  WHEN 1 THEN CAST(CAST(round(l_discount * 100) AS INT) AS VARCHAR) || '% off item ' || CAST(l_partkey AS VARCHAR) || ' today'
  WHEN 2 THEN '£' || CAST(CAST(l_quantity AS INT) AS VARCHAR) || ' off when you spend at least £' || CAST(l_suppkey AS VARCHAR) || ' here'
  WHEN 3 THEN '<b>Free  delivery</b> on item ' || CAST(l_partkey AS VARCHAR) || ' now'
  WHEN 4 THEN 'Buy ' || CAST(CAST(l_quantity AS INT) AS VARCHAR) || ' get 1 free today'
  WHEN 5 THEN 'Extra  discount, min spend of £' || CAST(l_suppkey AS VARCHAR) || '.50 applies'
  WHEN 6 THEN CAST(CAST(round(l_discount * 100) AS INT) AS VARCHAR) || '.5% OFF plus £' || CAST(CAST(l_quantity AS INT) AS VARCHAR) || ' back today'
  ELSE 'Sponsored: ' || CAST(CAST(round(l_discount * 100) AS INT) AS VARCHAR) || '% off'
END
"""


# -- the rules in SQL ---------------------------------------------------------------------------


def sql_trim(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '^{SPACE}+', ''), '{SPACE}+$', '')"


def sql_plain(text: str) -> str:
    """Description without tags and CDATA marks, white space collapsed."""
    bare = f"regexp_replace({text}, '(?i)<!\\[CDATA\\[', '', 'g')"
    bare = f"regexp_replace({bare}, '\\]\\]>', '', 'g')"
    bare = f"regexp_replace({bare}, '<[^>]+>', '', 'g')"
    return sql_trim(f"regexp_replace({bare}, '{SPACE}+', ' ', 'g')")


def sql_clean(plain: str) -> str:
    """Cleaned description of an already plain text."""
    head = f"substr({plain}, 1, 201)"
    last = f"(length({head}) - strpos(reverse({head}), ' '))"
    noise = "|".join(fixed.NOISE_OPENINGS)
    return (
        f"CASE WHEN regexp_matches({plain}, '(?i)^(?:{noise})') OR length({plain}) < 5 THEN '' "
        f"WHEN strpos({head}, ' ') > 0 AND {last} > 0 THEN substr({plain}, 1, {last}) "
        f"ELSE substr({plain}, 1, 200) END"
    )


def sql_type(text: str, extra: bool = False) -> str:
    kinds = fixed.OFFER_KINDS[:-1] + (fixed.EXTRA_KIND,) if extra else fixed.OFFER_KINDS
    arms = " ".join(f"WHEN regexp_matches(lower({text}), '{pattern}') THEN '{kind}'" for kind, _, pattern in kinds)
    return f"CASE {arms} ELSE 'unknown' END"


def sql_first(text: str, pattern: str) -> str:
    pattern = pattern.replace("'", "''")
    return f"nullif(regexp_extract({text}, '{pattern}', 1), '')"


def sql_value(text: str, kind: str) -> str:
    return (
        f"CASE {kind} WHEN 'percentage' THEN CAST({sql_first(text, fixed.PERCENT_OFF)} AS DOUBLE) "
        f"WHEN 'fixed' THEN CAST({sql_first(text, fixed.POUNDS)} AS DOUBLE) END"
    )


def sql_min_spend(text: str) -> str:
    return f"CAST({sql_first(text, fixed.MIN_SPEND)} AS DOUBLE)"


def sql_valid_code(code: str) -> str:
    return (
        f"(length({code}) BETWEEN 3 AND 30 AND regexp_matches({code}, '[A-Za-z]') "
        f"AND (regexp_matches({code}, '[0-9]') OR (length({code}) >= 6 AND {code} = upper({code}))) "
        f"AND upper({code}) NOT IN ({quoted(fixed.COMMON_WORDS)}))"
    )


def sql_candidate(token: str, prefixes=fixed.STOP_PREFIXES) -> str:
    return (
        f"(regexp_matches({token}, '[A-Z]') AND (regexp_matches({token}, '[0-9]') OR length({token}) >= 6) "
        f"AND NOT regexp_matches({token}, '^(?:{'|'.join(prefixes)})'))"
    )


def sql_norm(code: str) -> str:
    return f"regexp_replace(upper({code}), '[{fixed.SPACE_SET}_-]+', '', 'g')"


SQL_HOST = "regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\\.', '')"


def pence(amount: Column) -> Column:
    """An optional amount as whole pence, -1 for none."""
    return F.coalesce(F.floor(amount * 100 + 0.5), F.lit(-1)).cast("long")


def sql_pence(amount: str) -> str:
    return f"coalesce(CAST(floor({amount} * 100 + 0.5) AS BIGINT), -1)"


def stamp(moment: Column) -> Column:
    return F.coalesce(F.date_format(moment, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(""))


def sql_stamp(moment: str) -> str:
    return f"coalesce(strftime({moment}, '%Y-%m-%d %H:%M:%S.%f'), '')"
