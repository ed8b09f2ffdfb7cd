"""Structural rules of skill documents(skill, text): what is missing is a finding (skill, level, rule, message).

A document's frontmatter begins at a first line of --- and ends at the next; without one all is body. Rules are Column
expressions over whole bodies; only the rules about links and paths take them apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Headings that a body must have, as patterns, with the names that findings give them.
HEADINGS = ("When to use", ".*Process", "Examples?", "Deterministic", "Orchestration", "Constraints")
MOST_LINES = 500
FENCE = "(?m)^[ \\t]*```"


def sections(docs: DataFrame) -> DataFrame:
    """skill, frontmatter, body."""
    text = F.concat(F.coalesce("text", F.lit("")), F.lit("\n"))
    has = text.rlike("(?s)\\A---\\n")
    closed = text.rlike("(?s)\\A---\\n(.*?\\n)??---\\n")
    front = F.when(has & closed, F.regexp_extract(text, "(?s)\\A---\\n((?:.*?\\n)??)---\\n", 1)).when(has, F.regexp_extract(text, "(?s)\\A---\\n(.*)\\z", 1)).otherwise("")
    body = F.when(has & closed, F.regexp_extract(text, "(?s)\\A---\\n(?:.*?\\n)??---\\n(.*)\\z", 1)).when(has, "").otherwise(text)
    return docs.select("skill", F.regexp_replace(front, "\\n+\\z", "").alias("frontmatter"), F.regexp_replace(body, "\\n+\\z", "").alias("body"))


def line_count(body: Column) -> Column:
    return F.when(body == "", 0).otherwise(F.size(F.split(body, "\n"))).cast("long")


def has_heading(body: Column, pattern: str) -> Column:
    return body.rlike(f"(?im)^#{{2,6}}[ \\t]+{pattern}")


def structure_findings(parts: DataFrame) -> DataFrame:
    """Findings of the license, heading, length, code and list rules."""
    say = lambda rule, message: F.struct(F.lit("fail").alias("level"), F.lit(rule).alias("rule"), message.alias("message"))
    rules = [F.when(~F.col("frontmatter").rlike("(?m)^license:\\s"), say("PL001", F.lit("no license in the frontmatter")))]
    rules += [F.when(~has_heading(F.col("body"), h), say("PL002", F.lit(f"no heading {h}"))) for h in HEADINGS]
    rules.append(F.when(line_count(F.col("body")) > MOST_LINES, say("PL003", F.concat(F.lit("body has "), line_count(F.col("body")).cast("string"), F.lit(" lines")))))
    rules.append(F.when(~F.col("body").rlike(FENCE), say("PL004", F.lit("no code block"))))
    rules.append(F.when(~F.col("body").rlike("(?m)^[ \\t]*[-*]"), say("PL005", F.lit("no list"))))
    return parts.select("skill", F.explode(F.array_compact(F.array(*rules))).alias("f")).select("skill", "f.*")


def front_value(front: Column, key: str) -> Column:
    """A top-level text of the frontmatter that stands on its key's line, without quotes around it; null without the key or a value."""
    value = F.trim(F.regexp_extract(front, f"(?m)^{key}:[ \\t]*(.*)$", 1))
    return F.nullif(F.coalesce(F.nullif(F.regexp_extract(value, "^([\"'])(.*)\\1$", 2), F.lit("")), value), F.lit(""))


def spec_findings(parts: DataFrame) -> DataFrame:
    """Findings of the frontmatter's name and description: both are there, the name is the folder's, in lower case with hyphens and of 64 characters at most, the description of 1024."""
    name, about = front_value(F.col("frontmatter"), "name"), front_value(F.col("frontmatter"), "description")
    say = lambda rule, message: F.struct(F.lit("fail").alias("level"), F.lit(rule).alias("rule"), F.lit(message).alias("message"))
    rules = [
        F.when(name.isNull(), say("SPEC001", "no name")),
        F.when(name != F.col("skill"), say("SPEC002", "the name is not the folder's")),
        F.when(~name.rlike("^[a-z0-9]+(-[a-z0-9]+)*$") | (F.length(name) > 64), say("SPEC003", "the name is not 1 to 64 lower-case letters, digits and single hyphens")),
        F.when(about.isNull(), say("SPEC004", "no description")),
        F.when(F.length(about) > 1024, say("SPEC005", "the description has over 1024 characters")),
    ]
    return parts.select("skill", F.explode(F.array_compact(F.array(*rules))).alias("f")).select("skill", "f.*")


def link_targets(parts: DataFrame) -> DataFrame:
    """skill, target of each markdown link that names a file."""
    links = F.regexp_extract_all(F.col("body"), F.lit("\\[[^\\]\\n]*\\]\\(([^)\\n]+)\\)"), 1)
    rows = parts.select("skill", F.explode(links).alias("target"))
    return rows.where("target <> '' AND NOT target RLIKE '^(https?://|#|mailto:)'")


def code_paths(parts: DataFrame) -> DataFrame:
    """skill, target of each script path inside a fence at a line's start. Blocks are what stands between such fences, taken two by two."""
    blocks = F.split(F.concat(F.lit("\n"), "body"), "\\n```[^\\n]*")
    inside = F.filter(blocks, lambda b, i: i % 2 == 1)
    tokens = F.regexp_extract_all(F.array_join(inside, "\n"), F.lit("((?:\\./|\\$)\\S*(?:scripts|references|assets)/\\S+)"), 1)
    return parts.select("skill", F.explode(tokens).alias("target")).withColumn("target", F.regexp_replace("target", "[\"']", ""))


def path_findings(targets: DataFrame, files: DataFrame, rule: str) -> DataFrame:
    """Targets that aren't among files(skill, path): 'unverified' PATH where they hold a glob or variable, else a failure of the rule."""
    shaped = targets.distinct().withColumn("path", F.regexp_replace(F.regexp_replace("target", "#.*$", ""), "^\\./", ""))
    dynamic = F.col("target").rlike("[*?$]")
    missing = shaped.where(~dynamic).join(files, ["skill", "path"], "left_anti").select("skill", F.lit("fail").alias("level"), F.lit(rule).alias("rule"), F.col("target").alias("message"))
    return shaped.where(dynamic).select("skill", F.lit("unverified").alias("level"), F.lit("PATH").alias("rule"), F.col("target").alias("message")).unionByName(missing)


def findings(docs: DataFrame, files: DataFrame) -> DataFrame:
    parts = sections(docs)
    return structure_findings(parts).unionByName(path_findings(link_targets(parts), files, "PT002")).unionByName(path_findings(code_paths(parts), files, "PT001"))


def report(docs: DataFrame, files: DataFrame) -> DataFrame:
    """skill, passed, counts by rule family and the exit status: 2 with a structure finding, else 1 with a missing path, else 0."""
    found = findings(docs, files).groupBy("skill").agg(
        F.count("*").alias("findings"), F.count_if(F.col("rule").startswith("PL")).alias("structure"), F.count_if(F.col("rule").startswith("PT")).alias("paths"), F.count_if(F.col("level") == "unverified").alias("unverified"), F.count_if(F.col("level") == "fail").alias("failed")
    )
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    rows = docs.select("skill").distinct().join(found, "skill", "left").select("skill", n("findings"), n("structure"), n("paths"), n("unverified"), n("failed"))
    return rows.select("skill", (F.col("failed") == 0).alias("passed"), "findings", "structure", "paths", "unverified", F.when(F.col("structure") > 0, 2).when(F.col("paths") > 0, 1).otherwise(0).alias("exit_status"))


def payloads(found: DataFrame, docs: DataFrame) -> DataFrame:
    """skill, passed, payload: the findings of each skill of docs as one JSON document {"findings": [{level, rule, message}], "passed": ...}, ordered by rule and message."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rule", "message", "level"))), lambda x: F.struct(x["level"].alias("level"), x["rule"].alias("rule"), x["message"].alias("message")))
    by_skill = found.groupBy("skill").agg(listed.alias("findings"), (F.count_if(F.col("level") == "fail") == 0).alias("passed"))
    none = F.from_json(F.lit("[]"), "array<struct<level:string,rule:string,message:string>>")
    rows = docs.select("skill").distinct().join(by_skill, "skill", "left").select("skill", F.coalesce("findings", none).alias("findings"), F.coalesce("passed", F.lit(True)).alias("passed"))
    return rows.select("skill", "passed", F.to_json(F.struct("findings", "passed")).alias("payload"))


def child_findings(children: DataFrame) -> DataFrame:
    """Findings about children(skill, child, status, payload), checks that ran on their own: DEP001 where one gave no payload that can be read, DEP002 where its payload and its status say
    different things (0 passes, others don't)."""
    parsed = children.withColumn("passed", F.try_variant_get(F.try_parse_json("payload"), "$.passed", "boolean"))
    rule = F.when(F.col("passed").isNull(), "DEP001").when(F.col("passed") != (F.col("status") == 0), "DEP002")
    message = F.when(F.col("passed").isNull(), F.concat(F.lit("no verdict from "), "child")).otherwise(F.concat(F.lit("verdict and status differ: "), "child"))
    return parsed.select("skill", F.lit("fail").alias("level"), rule.alias("rule"), message.alias("message")).where("rule IS NOT NULL")


def unified(docs: DataFrame, files: DataFrame, children: DataFrame | None = None) -> DataFrame:
    """skill, structure, paths, spec, dependencies (findings of each part), passed over all of them, exit_status: 3 where a child has no verdict or contradicts itself, 2 with a structure or spec
    finding, 1 with a missing path, else 0."""
    parts = sections(docs)
    found = findings(docs, files).unionByName(spec_findings(parts))
    found = found if children is None else found.unionByName(child_findings(children))
    n = {name: F.count_if(F.col("rule").startswith(start) & (F.col("level") == "fail")).alias(name) for name, start in (("structure", "PL"), ("paths", "PT"), ("spec", "SPEC"), ("dependencies", "DEP"))}
    counted = found.groupBy("skill").agg(*n.values())
    rows = docs.select("skill").distinct().join(counted, "skill", "left").select("skill", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in n])
    status = F.when(F.col("dependencies") > 0, 3).when(F.col("structure") + F.col("spec") > 0, 2).when(F.col("paths") > 0, 1).otherwise(0)
    return rows.select("*", (status == 0).alias("passed"), status.alias("exit_status"))


#: Sections that a rewrite adds where they are missing: heading pattern, then what the draft says there.
DRAFT_SECTIONS = (
    ("When to use", "When to use[ \\t]*$", "- Situations that call for this skill, one on a line.\n- Situations that look alike and don't."),
    ("Examples", "Examples?[ \\t]*$", "1. What is asked for.\n2. What is done.\n3. What comes out."),
    ("Validation", "Validation", "- How a reader sees that it worked.\n- What to do if it didn't."),
)


def rewrite_draft(docs: DataFrame) -> DataFrame:
    """skill, the missing sections, and the document with a template for each of them appended."""
    parts = sections(docs)
    missing = F.array_compact(F.array(*[F.when(~has_heading(F.col("body"), p), F.struct(F.lit(n).alias("name"), F.lit(t).alias("template"))) for n, p, t in DRAFT_SECTIONS]))
    added = F.array_join(F.transform("found", lambda x: F.concat(F.lit("\n\n## "), x["name"], F.lit("\n\n"), x["template"])), "")
    rows = parts.withColumn("found", missing).join(docs.select("skill", "text"), "skill")
    return rows.select("skill", F.transform("found", lambda x: x["name"]).alias("missing"), F.concat(F.col("text"), added, F.when(F.size("found") > 0, F.lit("\n")).otherwise(F.lit(""))).alias("draft"))
