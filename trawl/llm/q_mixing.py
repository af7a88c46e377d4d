"""Query of the mixing operator, with its SQL."""

from pyspark.sql import DataFrame, SparkSession

from trawl.llm import mixing
from trawl.llm.shared import table


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), share=1.5, most=2).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('0/' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h
  FROM documents
), t AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM t
), r AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS everything, sum(w) OVER () AS all_w,
         sum(w) OVER f AS w_to, 2 * sum(source_size) OVER f AS cap_to
  FROM w
  WINDOW f AS (ORDER BY source_size::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), m AS (
  SELECT *, w * (everything - (cap_to - 2 * source_size)) > 2 * source_size * (all_w - w_to + w) AS is_full FROM r
), g AS (
  SELECT source, source_size,
         CASE WHEN is_full THEN (2 * source_size)::DOUBLE
              ELSE w * (everything - coalesce(sum(CASE WHEN is_full THEN 2 * source_size END) OVER (), 0))
                   / sum(CASE WHEN NOT is_full THEN w END) OVER () END AS target
  FROM m
), b AS (
  SELECT *, floor(target + 0.5)::BIGINT AS budget,
         CASE WHEN source_size = 0 THEN 0 ELSE floor(target + 0.5)::BIGINT // source_size END AS copies
  FROM g
), c AS (
  SELECT d.*, b.source_size, b.target, b.copies, b.budget - b.copies * b.source_size AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(d.size) OVER (PARTITION BY d.source, d.h) AS same
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target,
       (copies * size + CASE WHEN upto <= rest THEN size
                             WHEN upto - same < rest THEN size * (rest - (upto - same)) // same
                             ELSE 0 END)::BIGINT AS taken
FROM c
"""

QUERIES = {"op5_mix": op5_mix}
ORACLES = {"op5_mix": SQL}
