"""Small tables that several tests share."""

from trawl import schemas

DOCS = {
    "e1": "Gazprombank Joint Stock Company ru sanction bank",
    "e2": "GPB INTERNATIONAL SA lu sanction subsidiary",
    "e3": "Yahia Abdul Aziz AL-ABADSAH ps sanction person 1958",
    "e4": "Central Bank of the Russian Federation ru sanction",
}


def entity(id, caption, schema="Company", countries=("ru",), topics=("sanction",), datasets=("test",), text=None, **properties):
    return (id, schema, caption, list(countries), list(topics), list(datasets), properties, caption if text is None else text)


def entities(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.ENTITY)


def relations(spark, *rows):
    """Each (id, schema, source, target) and optionally properties."""
    return spark.createDataFrame([(r[0], r[1], r[2], r[3], None, r[4] if len(r) > 4 else {}) for r in rows], schemas.RELATION)


def bank_entities(spark):
    return entities(spark, *(entity(k, t.split(" ru ")[0], "Organization", text=t) for k, t in DOCS.items()))


def queries(spark, *texts):
    return spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "query_id string, query string")


def ids(run, query_id="0"):
    return [r.doc_id for r in run.where(f"query_id = '{query_id}'").orderBy("rank").collect()]
