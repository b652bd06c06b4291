"""A property graph as two tables, its build by merges, and the templates of graph queries.

nodes(label, key, name, rating, price, is_active, published, importance); edges(src_label, src, type, dst_label, dst).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relational import keep_by

NODE = "label string, key string, name string, rating double, price double, is_active boolean, published timestamp_ntz, importance double"
#: Edge types that mean the same.
SAME_TYPES = {"MENTIONS_TECHNOLOGY": "MENTIONS_TECH", "MENTIONS_EVENT": "DESCRIBES_EVENT", "HAS_TOPIC": "MENTIONS"}


def merge_nodes(nodes: DataFrame, order: str) -> DataFrame:
    """One node a label and key: the last written sets all properties, nulls too."""
    return keep_by(nodes, ["label", "key"], F.col(order)).drop(order)


def merge_edges(edges: DataFrame) -> DataFrame:
    """Each edge once, its type under the canonical name."""
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in SAME_TYPES.items() for x in pair]), F.col("type")), F.col("type"))
    return edges.withColumn("type", kind).dropDuplicates(["src_label", "src", "type", "dst_label", "dst"])


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame

    def node(self, label: str, prefix: str) -> DataFrame:
        """Nodes of a label, columns <prefix>_key and so on."""
        mine = self.nodes.filter(F.col("label") == label).drop("label")
        return mine.select(*[F.col(c).alias(f"{prefix}_{c}") for c in mine.columns])

    def edge(self, kind: str, src: str, dst: str, *, src_label: str | None = None) -> DataFrame:
        """Pairs (src, dst) of an edge type, under the names given."""
        mine = self.edges.filter(F.col("type") == kind)
        mine = mine.filter(F.col("src_label") == src_label) if src_label else mine
        return mine.select(F.col("src").alias(src), F.col("dst").alias(dst))

    # Templates: each returns key, score and evidence (sorted, joined by commas)

    def _restaurants(self, sold: DataFrame, limit: int | None, order: str = "rating") -> DataFrame:
        """Active restaurants r with the menus m by which they were found; rating descending, nulls first, then key."""
        found = sold.groupBy("r").agg(F.array_join(F.sort_array(F.collect_set("m")), ",").alias("evidence"))
        places = self.node("Restaurant", "r").filter("r_is_active")
        out = found.join(places, F.col("r") == F.col("r_key")).select(F.col("r").alias("key"), F.coalesce("r_rating", F.lit(0.0)).alias("score"), "evidence", F.col("r_rating").alias("rating"))
        out = out.orderBy(F.desc_nulls_first(order), "key")
        return (out.limit(limit) if limit else out).drop("rating")

    def _preferred(self, menu: str) -> DataFrame:
        """(r, m): restaurants that sell the menu or one related to it."""
        names = self.node("Menu", "m").filter(F.col("m_name") == menu).select(F.col("m_key").alias("m"))
        related = self.edge("RELATED_TO", "m", "concept", src_label="Menu").filter(F.col("concept") == menu).select("m")
        return self.edge("SELLS", "r", "m").join(names.unionByName(related).distinct(), "m")

    def exclude_ingredient(self, menu: str, ingredient: str, limit: int = 5) -> DataFrame:
        """Menus without the ingredient, at restaurants that sell the preferred one; nothing if no such ingredient exists."""
        known = self.node("Ingredient", "i").filter(F.col("i_key") == ingredient).select(F.lit(1).alias("known"))
        bad = self.edge("CONTAINS", "m", "i").filter(F.col("i") == ingredient).select("m")
        return self._restaurants(self._preferred(menu).join(bad, "m", "left_anti").filter(known.exists()), limit)

    def exclude_ingredient_everywhere(self, menu: str, ingredient: str, limit: int = 5) -> DataFrame:
        """As exclude_ingredient, but no menu of the restaurant may contain it."""
        bad = self.edge("SELLS", "r", "m").join(self.edge("CONTAINS", "m", "i").filter(F.col("i") == ingredient), "m").select("r").distinct()
        return self._restaurants(self._preferred(menu).join(bad, "r", "left_anti"), limit)

    def other_menus(self, menu: str, ingredient: str, limit: int = 5) -> DataFrame:
        """Other menus than the named one, without the ingredient, at restaurants that sell it."""
        bad = self.edge("CONTAINS", "m", "i").filter(F.col("i") == ingredient).select("m")
        sellers = self.edge("SELLS", "r", "m").filter(F.col("m") == menu).select("r").distinct()
        return self._restaurants(self.edge("SELLS", "r", "m").filter(F.col("m") != menu).join(sellers, "r").join(bad, "m", "left_anti"), limit)

    def tagged(self, menu: str, required: list[str], excluded: list[str], limit: int = 5) -> DataFrame:
        """Restaurants that sell the menu and have all required tags and none of the excluded ones."""
        sold = self._preferred(menu)
        tags = self.edge("HAS_TAG", "r", "t")
        if required:
            all_of = tags.filter(F.col("t").isin(*required)).groupBy("r").agg(F.count_distinct("t").alias("n")).filter(F.col("n") == len(required)).select("r")
            sold = sold.join(all_of, "r", "left_semi")
        if excluded:
            sold = sold.join(tags.filter(F.col("t").isin(*excluded)).select("r").distinct(), "r", "left_anti")
        return self._restaurants(sold, limit)

    def area_menu_tag(self, area: str, menu: str, tag: str, limit: int = 10) -> DataFrame:
        here = self.edge("LOCATED_IN", "r", "area").filter(F.col("area") == area).select("r")
        with_tag = self.edge("HAS_TAG", "r", "t").filter(F.col("t") == tag).select("r").distinct()
        return self._restaurants(self._preferred(menu).join(here, "r", "left_semi").join(with_tag, "r", "left_semi"), limit)

    def menu_only(self, menu: str) -> DataFrame:
        """key, score, areas, tags: optional neighbours of the restaurants that sell the menu."""
        base = self._restaurants(self._preferred(menu), None).drop("evidence")
        areas = self.edge("LOCATED_IN", "key", "area").groupBy("key").agg(F.array_join(F.sort_array(F.collect_set("area")), ",").alias("areas"))
        tags = self.edge("HAS_TAG", "key", "t").groupBy("key").agg(F.array_join(F.sort_array(F.collect_set("t")), ",").alias("tags"))
        return base.join(areas, "key", "left").join(tags, "key", "left").select("key", "score", F.coalesce("areas", F.lit("")).alias("areas"), F.coalesce("tags", F.lit("")).alias("tags"))

    def menu_tag_price(self, menu: str, tag: str, most: float, limit: int = 5) -> DataFrame:
        cheap = self.node("Restaurant", "r").filter(F.col("r_price") <= most).select(F.col("r_key").alias("r"))
        with_tag = self.edge("HAS_TAG", "r", "t").filter(F.col("t") == tag).select("r").distinct()
        return self._restaurants(self._preferred(menu).join(cheap, "r", "left_semi").join(with_tag, "r", "left_semi"), limit)

    def _articles(self, found: DataFrame, limit: int) -> DataFrame:
        """Articles a of found: key, published, importance; the newest first, then key."""
        out = found.select("a").distinct().join(self.node("Article", "a"), F.col("a") == F.col("a_key"))
        return out.select(F.col("a").alias("key"), F.col("a_published").alias("published"), F.col("a_importance").alias("importance")).orderBy(F.desc_nulls_first("published"), "key").limit(limit)

    def two_terms(self, tech: str, event: str, limit: int = 5) -> DataFrame:
        techs = self.edge("MENTIONS_TECH", "a", "t").filter(F.col("t") == tech).select("a")
        events = self.edge("DESCRIBES_EVENT", "a", "e").filter(F.col("e") == event).select("a")
        return self._articles(techs.join(events, "a", "left_semi"), limit)

    def topic(self, topic: str, limit: int = 10) -> DataFrame:
        """By importance, then date, then key."""
        found = self.edge("MENTIONS", "a", "topic").filter(F.col("topic") == topic).select("a").distinct()
        out = found.join(self.node("Article", "a"), F.col("a") == F.col("a_key"))
        return out.select(F.col("a").alias("key"), F.col("a_published").alias("published"), F.col("a_importance").alias("importance")).orderBy(F.desc_nulls_first("importance"), F.desc_nulls_first("published"), "key").limit(limit)

    def compare_companies(self, one: str, other: str, event: str, limit: int = 10) -> DataFrame:
        company = self.edge("MENTIONS_COMPANY", "a", "c")
        both = company.filter(F.col("c") == one).select("a").join(company.filter(F.col("c") == other).select("a"), "a", "left_semi")
        return self._articles(both.join(self.edge("DESCRIBES_EVENT", "a", "e").filter(F.col("e") == event).select("a"), "a", "left_semi"), limit)

    def topic_event(self, topic: str, event: str, limit: int = 10, *, neighbours: bool = True) -> DataFrame:
        """Articles of a topic and event; with neighbours, the technologies and companies they mention, if any."""
        found = self.edge("MENTIONS", "a", "topic").filter(F.col("topic") == topic).select("a").join(self.edge("DESCRIBES_EVENT", "a", "e").filter(F.col("e") == event).select("a"), "a", "left_semi")
        out = self._articles(found, limit)
        if not neighbours:
            return out
        for kind, name in (("MENTIONS_TECH", "techs"), ("MENTIONS_COMPANY", "companies")):
            near = self.edge(kind, "key", "n").groupBy("key").agg(F.array_join(F.sort_array(F.collect_set("n")), ",").alias(name))
            out = out.join(near, "key", "left").withColumn(name, F.coalesce(name, F.lit("")))
        return out

    def concept_bridge(self, concept: str) -> DataFrame:
        """label, key, score of restaurants and articles related to a concept."""
        related = self.edges.filter((F.col("type") == "RELATED_TO") & (F.col("dst") == concept) & F.col("src_label").isin("Restaurant", "Article"))
        return related.select(F.col("src_label").alias("label"), F.col("src").alias("key"), F.lit(0.8).alias("score")).distinct()

    def concept_bridge_lists(self, concept: str) -> DataFrame:
        """One row: how many restaurants and articles a concept joins, and the first of each by key."""
        each = self.concept_bridge(concept)
        of = lambda label: F.when(F.col("label") == label, F.col("key"))
        return each.agg(F.count(of("Restaurant")).alias("restaurants"), F.count(of("Article")).alias("articles"), F.min(of("Restaurant")).alias("first_restaurant"), F.min(of("Article")).alias("first_article"))

    def counts(self) -> DataFrame:
        """what, n: edges by type, paths restaurant - concept - article, and restaurants that sell nothing."""
        per_type = self.edges.groupBy(F.concat(F.lit("edge:"), "type").alias("what")).agg(F.count("*").alias("n"))
        related = self.edges.filter("type = 'RELATED_TO'").groupBy("src_label", "dst").agg(F.count("*").alias("n"))
        left = related.filter("src_label = 'Restaurant'").select("dst", F.col("n").alias("x"))
        right = related.filter("src_label = 'Article'").select("dst", F.col("n").alias("y"))
        bridges = left.join(right, "dst").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("n")).select(F.lit("bridges").alias("what"), "n")
        idle = self.node("Restaurant", "r").join(self.edge("SELLS", "r_key", "m").select("r_key").distinct(), "r_key", "left_anti").agg(F.count("*").alias("n")).select(F.lit("idle").alias("what"), "n")
        return per_type.unionByName(bridges).unionByName(idle)


def full_text(docs: DataFrame, key: str, tokens, query_words: list[str], limit: int) -> DataFrame:
    """key, score, descending: sum of tf ln(1 + N / df) over the query's words.

    Only postings of the query's words are built; df and N are aggregates of one row a word.
    """
    postings = docs.select(F.col(key).alias("key"), F.explode(tokens).alias("word")).filter(F.col("word").isin(*query_words)).groupBy("key", "word").agg(F.count("*").alias("tf"))
    df = postings.groupBy("word").agg(F.count("*").alias("df"))
    n = docs.agg(F.count("*")).scalar()
    scored = postings.join(F.broadcast(df), "word").withColumn("weight", F.col("tf") * F.ln(1 + n / F.col("df")))  # df: a row a query word
    return scored.groupBy("key").agg(F.round(F.sum("weight"), 6).alias("score")).orderBy(F.desc("score"), "key").limit(limit)
