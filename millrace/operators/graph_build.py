"""Graph tables from restaurant records, news rows and extracted keywords."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates, numbers
from ..functions import text as S
from . import dictionaries as D
from .graph import Graph, merge_edges, merge_nodes
from .records import menu_ingredients, unique_texts

PROPS = ("name", "address", "url", "rating", "summary", "published_at")
#: Edge type and node label of each kind of news term and of extracted keyword.
TERM_EDGES = {"technology": ("MENTIONS_TECH", "Technology"), "company": ("MENTIONS_COMPANY", "Company"), "event": ("DESCRIBES_EVENT", "Event"), "topic": ("MENTIONS", "Topic")}
KEYWORD_EDGES = {"Technology": "MENTIONS_TECHNOLOGY", "Company": "MENTIONS_COMPANY", "Event": "MENTIONS_EVENT", "Topic": "HAS_TOPIC"}


def node(df: DataFrame, label: str, key, **props) -> DataFrame:
    missing = {p: F.lit(None).cast("double" if p == "rating" else "string") for p in PROPS}
    columns = {p: (props[p] if p in props else missing[p]).alias(p) for p in PROPS}
    return df.select(F.lit(label).alias("label"), key.alias("key"), *columns.values())


def edge(df: DataFrame, src_label: str, src, kind, dst_label: str, dst) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return df.select(F.lit(src_label).alias("src_label"), src.alias("src"), kind.alias("type"), F.lit(dst_label).alias("dst_label"), dst.alias("dst"))


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def restaurant_graph(records: DataFrame, areas: DataFrame, recipes: DataFrame, fallback: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, rejects) of records(store, menus, reviews); areas(cd, name).

    A restaurant's key is its URL, else name|address, else its entity id; without one, or a name, the record is
    rejected. Menus count once a restaurant by raw name, and a null normalized name is as good as none.
    """
    s = "store"
    key = F.coalesce(S.blank(F.col(f"{s}.canonical_url")), F.when(S.blank(F.col(f"{s}.name")).isNotNull() & S.blank(F.col(f"{s}.address_detail")).isNotNull(), F.concat_ws("|", F.trim(f"{s}.name"), F.trim(f"{s}.address_detail"))), S.blank(F.col(f"{s}.entity_id")))
    keyed = records.withColumn("r", key)
    bad = keyed.filter(F.col("r").isNull() | S.blank(F.col(f"{s}.name")).isNull()).select(F.col(f"{s}.entity_id").alias("entity_id"), F.lit("INVALID_DATA_FORMAT").alias("reason_code"))
    good = keyed.filter(F.col("r").isNotNull() & S.blank(F.col(f"{s}.name")).isNotNull())
    code = F.nullif(S.blank(F.col(f"{s}.address_cd")), F.lit("UNKNOWN"))
    located = good.select("r", code.alias("cd")).filter("cd IS NOT NULL").join(areas.withColumnRenamed("name", "area_name"), "cd", "left").withColumn("area_name", F.coalesce("area_name", "cd"))
    menus = good.select("r", F.posexplode("menus").alias("pos", "m")).select("r", "pos", S.blank(F.col("m.name")).alias("raw_name"), S.blank(F.col("m.normalized_name")).alias("normalized_name"), S.blank(F.col("m.recipe_search_keyword")).alias("recipe_keyword"), numbers.int_or_zero(F.col("m.price")).alias("price")).filter("raw_name IS NOT NULL")
    menus = menus.groupBy("r", "raw_name").agg(F.min_by(F.struct("normalized_name", "recipe_keyword", "price"), "pos").alias("x")).select("r", "raw_name", "x.*")
    name = F.coalesce("normalized_name", "raw_name")
    inside = menu_ingredients(menus, recipes, fallback)
    tags = good.select("r", F.explode("reviews").alias("v")).select("r", F.explode(unique_texts(F.col("v.keywords"))).alias("tag")).distinct()
    nodes = union([
        node(good, "Restaurant", F.col("r"), name=F.col(f"{s}.name"), address=F.coalesce(f"{s}.address_detail", F.lit("")), url=F.coalesce(f"{s}.canonical_url", F.lit("")), rating=numbers.finite(F.col(f"{s}.rating"))),
        node(located, "Area", F.col("cd"), name=F.col("area_name")),
        node(menus, "Menu", name, name=name),
        node(inside, "Ingredient", F.col("ingredient"), name=F.col("ingredient")),
        node(tags, "Tag", F.col("tag"), name=F.col("tag")),
    ])
    edges = union([
        edge(located, "Restaurant", F.col("r"), "LOCATED_IN", "Area", F.col("cd")),
        edge(menus, "Restaurant", F.col("r"), "SELLS", "Menu", name),
        edge(inside, "Menu", F.col("menu"), "CONTAINS", "Ingredient", F.col("ingredient")),
        edge(tags, "Restaurant", F.col("r"), "HAS_TAG", "Tag", F.col("tag")),
    ])
    return nodes.dropDuplicates(["label", "key"]), merge_edges(edges), bad


def news_graph(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of rows(thread, title, content, article_url, created_at): articles and the terms they mention."""
    text = F.concat_ws(" ", "title", "content")
    found = rows.select("thread", D.all_terms(text).alias("found"))
    said = found.select("thread", F.array(*[F.struct(F.lit(kind).alias("kind"), D.of_kind(F.col("found"), k).alias("terms")) for k, (kind, _) in TERM_EDGES.items()]).alias("x")).select("thread", F.inline("x")).select("thread", "kind", F.explode("terms").alias("term"))
    labels = F.create_map(*[F.lit(x) for kind, label in TERM_EDGES.values() for x in (kind, label)])
    articles = node(rows, "Article", F.col("thread"), name=F.col("title"), summary=S.summary(F.col("content")), url=F.coalesce("article_url", F.lit("")), published_at=dates.iso_or_epoch(F.col("created_at")))
    terms = said.select(F.element_at(labels, F.col("kind")).alias("label"), F.col("term").alias("key"), F.col("term").alias("name")).distinct()
    terms = terms.select("label", "key", *[F.col("name") if p == "name" else F.lit(None).cast("double" if p == "rating" else "string").alias(p) for p in PROPS])
    edges = said.select(F.lit("Article").alias("src_label"), F.col("thread").alias("src"), F.col("kind").alias("type"), F.element_at(labels, F.col("kind")).alias("dst_label"), F.col("term").alias("dst"))
    return articles.dropDuplicates(["label", "key"]).unionByName(terms), merge_edges(edges)


def keyword_edges(records: DataFrame) -> DataFrame:
    """Edges of records(article_id, keywords array<struct<kind, name>>); kinds without an edge type are left out."""
    each = records.select("article_id", F.inline("keywords")).withColumn("type", F.element_at(F.create_map(*[F.lit(x) for p in KEYWORD_EDGES.items() for x in p]), F.col("kind"))).filter("type IS NOT NULL")
    return merge_edges(each.select(F.lit("Article").alias("src_label"), F.col("article_id").alias("src"), "type", F.col("kind").alias("dst_label"), F.col("name").alias("dst")))


def concept_edges(nodes: DataFrame, concepts: DataFrame) -> DataFrame:
    """RELATED_TO from nodes(label, key, name) to the concepts of the same normalized name, where there are any."""
    normal = lambda c: F.lower(F.replace(F.trim(c), F.lit(" "), F.lit("")))
    wanted = concepts.select(normal(F.col("name")).alias("n"), F.col("key").alias("dst")).distinct()
    both = nodes.withColumn("n", normal(F.col("name"))).join(wanted, "n")
    return both.select(F.col("label").alias("src_label"), F.col("key").alias("src"), F.lit("RELATED_TO").alias("type"), F.lit("Concept").alias("dst_label"), "dst")


def merged(batches: list[tuple[DataFrame, DataFrame]]) -> Graph:
    """One graph of several imports: of a node the last one counts, of an edge any."""
    nodes = union([n.withColumn("seq", F.lit(k)) for k, (n, _) in enumerate(batches)])
    return Graph(merge_nodes(nodes, "seq"), merge_edges(union([e for _, e in batches])))
