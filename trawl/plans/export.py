"""The graph as a vault of linked notes: one file for each entity, written by the executors."""

from __future__ import annotations

import json
import os
import shutil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.functions.text import safe_name, tag
from trawl.operators import graph

MARKER, NOTES = ".trawl-export", "Entities"
# The properties that a note shows, in order.
SHOWN = "birthDate birthPlace nationality incorporationDate jurisdiction registrationNumber taxNumber idNumber passportNumber imoNumber position program programId sanctionStatus address notes".split()
ALIASES = ("alias", "weakAlias", "previousName")
GRAPH_VIEW = {
    "colorGroups": [{"query": f"tag:#{q}", "color": {"a": 1, "rgb": c}} for q, c in (("topic/sanction", 0xE05252), ("topic/role-pep", 0xE67E22), ("schema/person", 0x3B82F6), ("schema/vessel", 0x14B8A6))],
    "showTags": False,
    "showOrphans": False,
}


def note_names(entities: DataFrame) -> DataFrame:
    """``id, name``: from the caption; names that clash, whatever their case, get the end of the id."""
    named = entities.select("id", safe_name(F.col("caption")).alias("base"))
    same = F.count("*").over(Window.partitionBy(F.lower("base")))
    return named.select("id", F.when(same == 1, F.col("base")).otherwise(F.concat("base", F.lit(" ("), F.right("id", F.lit(6)), F.lit(")"))).alias("name"))


def _line(name: str, value: Column) -> Column:
    """A line of front matter. JSON values are YAML too."""
    return F.concat(F.lit(f"{name}: "), value)


def _texts(values: Column) -> Column:
    none = F.array().cast("array<string>")
    quoted = F.transform(F.coalesce(values, none), quoted_text)
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def quoted_text(value: Column) -> Column:
    return F.regexp_extract(F.to_json(F.struct(value.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)


def notes(entities: DataFrame, relations: DataFrame, source: str = "entity") -> DataFrame:
    """``path, content`` of the notes of ``entities`` and the relations among them."""
    p, none = F.col("properties"), F.array().cast("array<string>")
    named = note_names(entities)
    inside = graph.phrased(graph.induced(relations, entities))
    links = inside.join(named.select(F.col("id").alias("other"), F.col("name").alias("target")), "other")
    line = F.concat(F.lit("- "), "phrase", F.lit(" [["), "target", F.lit("]]"), F.when(F.col("detail") != "", F.concat(F.lit(" ("), "detail", F.lit(")"))).otherwise(F.lit("")))
    linked = links.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("phrase", "target", "detail", line.alias("line")))).alias("links"))
    aliases = F.slice(F.array_distinct(F.filter(F.concat(*(F.coalesce(p[k], none) for k in ALIASES)), lambda a: (a != "") & (a != F.col("caption")))), 1, 20)
    tags = F.concat(F.array(tag("schema", F.col("schema"))), F.transform("topics", lambda t: tag("topic", t)), F.transform("datasets", lambda d: tag("list", d)))

    def fact(key: str) -> Column:
        value = F.translate(F.array_join(F.slice(p[key], 1, 4), "; "), "|\n", "/ ")
        return F.when(F.size(p[key]) > 0, F.concat(F.lit(f"| {key} | "), F.substring(value, 1, 300), F.lit(" |")))

    rows = entities.join(named, "id").join(linked, "id", "left").withColumn("aliases", aliases).withColumn("facts", F.array_compact(F.array(*map(fact, SHOWN))))
    head = F.concat_ws("\n", F.lit("---"), _line("id", quoted_text(F.col("id"))), _line("schema", quoted_text(F.col("schema"))), _line("aliases", _texts(F.col("aliases"))), _line("countries", _texts(F.col("countries"))), _line("topics", _texts(F.col("topics"))), _line("datasets", _texts(F.col("datasets"))), _line("tags", _texts(tags)), F.lit("---\n"), F.concat(F.lit("# "), "caption", F.lit("\n")))
    body = F.concat_ws(
        "\n", head,
        F.when(F.size("facts") > 0, F.concat(F.lit("| field | value |\n|---|---|\n"), F.array_join("facts", "\n"), F.lit("\n"))),
        F.when(F.size("aliases") > 0, F.concat(F.lit("**Also listed as:** "), F.array_join("aliases", "; "), F.lit("\n"))),
        F.when(F.size("links") > 0, F.concat(F.lit("## Relations\n\n"), F.array_join("links.line", "\n"), F.lit("\n"))),
        F.concat(F.lit(f"Source: {source} `"), "id", F.lit("`.\n")),
    )
    return rows.select(F.concat_ws("/", F.lit(NOTES), safe_name(F.col("schema")), F.concat("name", F.lit(".md"))).alias("path"), body.alias("content"))


def index_note(entities: DataFrame, relations: DataFrame) -> tuple[str, int, int]:
    """The vault's index, and the numbers of notes and relations."""
    inside = graph.induced(relations, entities).cache()
    kinds = entities.groupBy("schema").count().orderBy(F.desc("count"), "schema").collect()
    n, m = sum(r["count"] for r in kinds), inside.count()
    top = graph.hubs(inside).join(note_names(entities), "id").orderBy(F.desc("degree"), "id").collect()
    inside.unpersist()
    lines = ["# Entity graph", "", f"{n} entities and {m} relations. Red: sanctioned; orange: politically exposed; blue: person; green: vessel.", "", "## By type", ""]
    lines += [f"- {r.schema}: {r['count']}" for r in kinds] + ["", "## Most connected", ""] + [f"- [[{r.name}]] ({r.degree} links)" for r in top]
    return "\n".join(lines) + "\n", n, m


def export(entities: DataFrame, relations: DataFrame, out: str, mode: str = "connected", seed: str | None = None, hops: int = 2) -> dict[str, int]:
    """Writes the vault to a folder that driver and executors share. A folder of notes that this didn't write is never touched."""
    if os.path.exists(f"{out}/{NOTES}"):
        if not os.path.exists(f"{out}/{MARKER}"):
            raise SystemExit(f"{out}/{NOTES} exists and was not written by this exporter; refusing to overwrite")
        shutil.rmtree(f"{out}/{NOTES}")
    chosen = entities.join(graph.select_ids(entities, relations, mode, seed, hops), "id", "left_semi")
    text, n, m = index_note(chosen, relations)
    os.makedirs(f"{out}/{NOTES}", exist_ok=True)
    with open(f"{out}/{MARKER}", "w", encoding="utf-8") as f:
        f.write("written by the exporter\n")

    def write(rows) -> None:
        for r in rows:
            path = os.path.join(out, r.path)
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "w", encoding="utf-8") as f:
                f.write(r.content)

    notes(chosen, relations).foreachPartition(write)
    with open(f"{out}/Index.md", "w", encoding="utf-8") as f:
        f.write(text)
    os.makedirs(f"{out}/.obsidian", exist_ok=True)
    if not os.path.exists(view := f"{out}/.obsidian/graph.json"):
        with open(view, "w", encoding="utf-8") as f:
            json.dump(GRAPH_VIEW, f, indent=2)
    return {"notes": n, "relations": m}
