"""Deterministic Dutch-style letters made from the customer and nation tables.

The sample documents hold almost no Dutch identifiers; every letter holds one of
most kinds, and what it holds is known by construction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.sources.readers import spread_rows

LETTER_SQL = """
  'Op ' || lpad(CAST(1 + c.c_custkey % 28 AS STRING), 2, '0') || '-'
        || lpad(CAST(1 + c.c_custkey % 12 AS STRING), 2, '0') || '-'
        || CAST(1990 + c.c_custkey % 30 AS STRING)
  || ' schreef ' || c.c_name || ' uit ' || n.n_name
  || ' (BSN: ' || lpad(CAST((c.c_custkey * 7919 + 123456782) % 1000000000 AS STRING), 9, '0')
  || '). Mail: klant' || CAST(c.c_custkey AS STRING) || '@voorbeeld.nl, tel 06'
  || lpad(CAST((c.c_custkey * 104729) % 100000000 AS STRING), 8, '0')
  || '. IBAN: NL91ABNA' || lpad(CAST((c.c_custkey * 1299709 + 417164300) % 10000000000 AS STRING), 10, '0')
  || '. KvK: ' || lpad(CAST((c.c_custkey * 15485863 + 12345678) % 100000000 AS STRING), 8, '0')
  || ', btw NL' || lpad(CAST((c.c_custkey * 32452843 + 123456789) % 1000000000 AS STRING), 9, '0') || 'B01'
  || ', zaak Z-2023-' || lpad(CAST(c.c_custkey % 100000 AS STRING), 5, '0')
  || ', kenteken AB-' || lpad(CAST(c.c_custkey % 100 AS STRING), 2, '0') || '-CD'
  || ', paspoort ZX' || lpad(CAST(1000000 + c.c_custkey AS STRING), 7, '0')
  || ', postcode ' || CAST(1000 + c.c_custkey % 9000 AS STRING) || ' AB'
  || ', IP 192.168.' || CAST(c.c_custkey % 256 AS STRING) || '.1'
  || ', MAC AA:BB:CC:DD:EE:' || lpad(CAST(c.c_custkey % 100 AS STRING), 2, '0') || '.'
"""


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, text, c_name, n_name``: one letter per customer.

    ``nation`` is a fixed code table (25 rows in TPC-H); Spark broadcasts it by
    its measured size.  Customers are dealt over splits while their rows are narrow.
    """
    c = spread_rows(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_nationkey"))
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name")
    joined = c.alias("c").join(n.alias("n"), F.col("c.c_nationkey") == F.col("n.n_nationkey"))
    return joined.select(
        F.col("c.c_custkey").alias("doc_id"), F.expr(LETTER_SQL).alias("text"), "c.c_name", "n.n_name")


# One value of every format the letters lack, from an order key.
DOSSIER_SQL = """
  'Dossier WOO-2023-' || lpad(CAST(o_orderkey % 100000 AS STRING), 5, '0')
  || ' en C/13/' || lpad(CAST(o_orderkey % 1000000 AS STRING), 6, '0')
  || ', AWB 21/' || lpad(CAST(o_orderkey % 100000 AS STRING), 5, '0')
  || ', HR 22/' || lpad(CAST(o_orderkey % 100000 AS STRING), 5, '0')
  || ', hof 200.' || lpad(CAST(o_orderkey % 100000 AS STRING), 5, '0')
  || ', parket 08/' || lpad(CAST(o_orderkey % 1000000 AS STRING), 6, '0') || '-23'
  || ', RBAMS 20/' || lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0')
  || ', zaak ' || lpad(CAST(o_orderkey % 100000000 AS STRING), 8, '0') || '-12ab-34cd-56ef-0123456789ab'
  || ', BAG 0363' || lpad(CAST(o_orderkey % 1000000000000 AS STRING), 12, '0')
  || '. Rekening DE' || lpad(CAST(o_orderkey % 100 AS STRING), 2, '0') || ' 3704 0044 0532 '
  || lpad(CAST(o_custkey % 10000 AS STRING), 4, '0') || ' 00'
  || '; document XY' || CAST(111111 + o_custkey % 8 AS STRING) || '7'
  || '; gezien 2021-0' || CAST(1 + o_orderkey % 9 AS STRING) || '-1' || CAST(o_orderkey % 10 AS STRING)
  || ', 1' || CAST(o_orderkey % 10 AS STRING) || ' 0' || CAST(1 + o_orderkey % 9 AS STRING) || ' 24'
  || ' en ' || CAST(1 + o_orderkey % 28 AS STRING) || ' september 2020'
  || '; apparaat A0-B1-C2-D3-E4-' || lpad(CAST(o_orderkey % 100 AS STRING), 2, '0')
  || ' en 00AA.11BB.' || lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0') || ' klaar.'
"""


def dossiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, text``: one file note per order, with the formats letters lack."""
    orders = spread_rows(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey"))
    return orders.select(F.col("o_orderkey").alias("doc_id"), F.expr(DOSSIER_SQL).alias("text"))
