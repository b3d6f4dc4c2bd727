"""JSON manifests with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEDIA = "base string, destRoot string, pages map<string, array<struct<src:string,file:string,role:string,alt:string>>>"
IMPORTED = "map<string, array<struct<file:string,src:string,role:string,alt:string,targetPath:string>>>"
ARTICLES = (
    "base string, folder string, articles array<struct<name:string,title:string,excerpt:string,date:string,"
    "image:string,imgFile:string,category:string,body:array<string>,done:boolean>>"
)
PAGE = (
    "base string, page string, "
    "hero struct<heading:string,subtitle:string,image:string,imgFile:string>, "
    "intro struct<overline:string,heading:string,body:string>, "
    "blocks array<struct<heading:string,body:array<string>,image:string,imgFile:string,imageAlt:string,"
    "ctaLabel:string,dark:boolean>>"
)
FINGERPRINTS = "map<string, struct<t:int,i:int,h2:array<string>,sec:int,error:string>>"
COMPONENTS = (
    "components array<struct<nodeType:string,areaType:string,needsMainResource:boolean,isContainer:boolean,"
    "childType:string,sources:array<string>,fields:array<string>,clusterFrequency:int>>, ignored array<string>"
)
FOLDERS = (
    "contentsBase string, chromeTypes array<string>, titleType string, bodyTypes array<string>, folders map<string,"
    "struct<type:string,urlPrefixes:array<string>,listingPages:array<string>,fieldMap:map<string,string>>>"
)
PLAN = (
    "epics array<struct<id:string,stories:array<struct<id:string,steps:array<struct<id:string,title:string,"
    "task_type:string,depends_on:array<string>>>>>>>"
)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per multi-line JSON document with a struct schema."""
    return spark.read.option("multiLine", "true").schema(schema).json(path)


def read_json_map(spark: SparkSession, path: str, schema: str, name: str) -> DataFrame:
    """Documents whose top level is an open map: one column ``name``."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.from_json("value", schema).alias(name))


def media_items(manifest: DataFrame) -> DataFrame:
    """(base, page, seq, src, file, role, alt)"""
    pages = manifest.select("base", F.explode("pages").alias("page", "_items"))
    return pages.select("base", "page", F.posexplode("_items").alias("seq", "_i")).select("base", "page", "seq", "_i.*")


def imported_items(doc: DataFrame, name: str = "pages") -> DataFrame:
    """(page, seq, file, src, role, alt, target_path); older documents lack the file name."""
    pages = doc.select(F.explode(name).alias("page", "_items"))
    rows = pages.select("page", F.posexplode("_items").alias("seq", "_i")).select("page", "seq", "_i.*")
    return rows.withColumn("file", F.coalesce("file", F.substring_index("targetPath", "/", -1))).withColumnRenamed(
        "targetPath", "target_path"
    )


def articles(manifest: DataFrame) -> DataFrame:
    return manifest.select("base", "folder", F.posexplode("articles").alias("seq", "_a")).select(
        "base", "folder", "seq", "_a.*"
    )


def page_units(manifest: DataFrame) -> DataFrame:
    """Hero, intro and block rows of a page manifest under one schema."""
    hero = manifest.where("hero IS NOT NULL").select(
        "page", F.lit("hero").alias("name"), F.lit("pageHero").alias("node_type"), "hero.heading",
        F.col("hero.subtitle").alias("subtitle"), "hero.image",
    )
    intro = manifest.where("intro IS NOT NULL").select(
        "page", F.lit("intro").alias("name"), F.lit("introText").alias("node_type"), "intro.overline", "intro.heading", "intro.body"
    )
    blocks = manifest.select("page", F.posexplode("blocks").alias("i", "b")).select(
        "page", F.concat(F.lit("block-"), F.col("i")).alias("name"), F.lit("editorialBlock").alias("node_type"),
        F.coalesce("b.heading", F.lit("")).alias("heading"), F.coalesce(F.array_join("b.body", ""), F.lit("")).alias("body"),
        "b.image", F.col("b.imageAlt").alias("image_alt"), F.col("b.ctaLabel").alias("cta_label"),
        F.coalesce("b.dark", F.lit(False)).alias("dark"),
    )
    return hero.unionByName(intro, allowMissingColumns=True).unionByName(blocks, allowMissingColumns=True)


def fingerprints(doc: DataFrame, name: str = "pages") -> DataFrame:
    return doc.select(F.explode(name).alias("page", "_f")).select("page", "_f.*")


def component_manifest(doc: DataFrame) -> DataFrame:
    """(ord, nodeType, areaType, needsMainResource, isContainer, ..., sources)"""
    return doc.select(F.posexplode("components").alias("ord", "_c")).select("ord", "_c.*")


def folder_rows(doc: DataFrame) -> DataFrame:
    """(ord, folder, type, urlPrefixes, listingPages, fieldMap) in document order."""
    entries = F.map_entries("folders")
    return doc.select(F.posexplode(entries).alias("ord", "_e")).select("ord", F.col("_e.key").alias("folder"), "_e.value.*")


def plan_steps(doc: DataFrame) -> DataFrame:
    """(epic, story, step_seq, step, title, task_type, depends_on)"""
    stories = doc.select(F.posexplode("epics").alias("epic_seq", "_e")).select(
        "epic_seq", F.col("_e.id").alias("epic"), F.posexplode("_e.stories").alias("story_seq", "_s")
    )
    steps = stories.select(
        "epic_seq", "epic", "story_seq", F.col("_s.id").alias("story"), F.posexplode("_s.steps").alias("step_seq", "_t")
    )
    return steps.select(
        "epic_seq", "epic", "story_seq", "story", "step_seq", F.col("_t.id").alias("step"),
        "_t.title", "_t.task_type", "_t.depends_on",
    )
