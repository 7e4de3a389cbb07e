"""Codelists: search, hierarchy, subsets, comparison and use of codes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eralith.sources.clinical import Clinical


def search(c: Clinical, words: Sequence[str], exclude: Sequence[str] = (), domains: Sequence[str] = (), standard: bool = True, descendants: bool = False) -> DataFrame:
    """Concepts whose name holds one of the words and none of exclude, in any case; wildcards have no meaning."""
    concept = c["concept"]
    name = F.lower("concept_name")
    hit = F.lit(False)
    for w in words:
        hit = hit | name.contains(w.lower())
    for w in exclude:
        hit = hit & ~name.contains(w.lower())
    if domains:
        hit = hit & F.lower("domain_id").isin([d.lower() for d in domains])
    if standard:
        hit = hit & (F.col("standard_concept") == "S")
    found = concept.where(hit)
    if not descendants:
        return found
    down = c["concept_ancestor"].join(found.select(F.col("concept_id").alias("ancestor_concept_id")), "ancestor_concept_id").select(F.col("descendant_concept_id").alias("concept_id")).distinct()
    return concept.join(down.union(found.select("concept_id")).distinct(), "concept_id", "left_semi")


def descendants(c: Clinical, ids: Sequence[int]) -> DataFrame:
    """(ancestor_concept_id, concept_id, concept_name) below each id, itself included."""
    a = c["concept_ancestor"].where(F.col("ancestor_concept_id").isin(list(ids)))
    return a.join(c["concept"], a["descendant_concept_id"] == c["concept"]["concept_id"]).select("ancestor_concept_id", "concept_id", "concept_name")


def below(c: Clinical, ids: Sequence[int]) -> DataFrame:
    """(concept_id): one row for each row of the hierarchy below the ids; a code that stands there several times comes as often."""
    return c["concept_ancestor"].where(F.col("ancestor_concept_id").isin(list(ids))).select(F.col("descendant_concept_id").alias("concept_id"))


def ingredient_codes(c: Clinical) -> DataFrame:
    """(ingredient, concept_id) of every ingredient's descendants."""
    i = c["concept"].where("concept_class_id = 'Ingredient'").select(F.col("concept_id").alias("ancestor_concept_id"), F.col("concept_name").alias("ingredient"))
    return i.join(c["concept_ancestor"], "ancestor_concept_id").select("ingredient", F.col("descendant_concept_id").alias("concept_id"))


def subset_by_class(c: Clinical, ids: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Codes of the list, each once, with a concept of the classes."""
    return ids.distinct().join(c["concept"].where(F.col("concept_class_id").isin(list(classes))), "concept_id", "left_semi")


def atc_codes(c: Clinical, word: str | None = None, levels: Sequence[str] = ()) -> DataFrame:
    """(name, concept_id) of ATC concepts by a word of their names and by level, such as "ATC 1st"."""
    a = c["concept"].where("vocabulary_id = 'ATC'")
    a = a.where(F.lower("concept_name").contains(word.lower())) if word else a
    a = a.where(F.col("concept_class_id").isin(list(levels))) if levels else a
    return a.select(F.regexp_replace(F.lower("concept_name"), " ", "_").alias("name"), F.col("concept_id").cast("long").alias("concept_id")).distinct()


def subset_by_vocabulary(c: Clinical, ids: DataFrame, vocabularies: Sequence[str]) -> DataFrame:
    """Codes of the list, each once, with a concept of the vocabularies."""
    return ids.distinct().join(c["concept"].where(F.col("vocabulary_id").isin(list(vocabularies))), "concept_id", "left_semi")


def stratify_by_domain(c: Clinical, ids: DataFrame) -> DataFrame:
    return stratify_by_class(c, ids, "domain_id")


def stratify_by_vocabulary(c: Clinical, ids: DataFrame) -> DataFrame:
    return stratify_by_class(c, ids, "vocabulary_id")


def stratify_by_class(c: Clinical, ids: DataFrame, column: str = "concept_class_id") -> DataFrame:
    """Codes by class, or by another column of concepts: (column, n_concepts, concept_ids)."""
    return ids.join(c["concept"], "concept_id").groupBy(column).agg(F.count_distinct("concept_id").alias("n_concepts"), F.array_sort(F.collect_set("concept_id")).alias("concept_ids"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """(concept_id, in_codelist): only in the first, only in the second, or in both."""
    both = a.select("concept_id").distinct().withColumn("a", F.lit(1)).join(b.select("concept_id").distinct().withColumn("b", F.lit(1)), "concept_id", "full")
    return both.select("concept_id", F.when(F.col("a").isNull(), "only second").when(F.col("b").isNull(), "only first").otherwise("both").alias("in_codelist"))


def code_use(c: Clinical, ids: DataFrame, domain: str = "drug", by: Sequence[str] = (), repeats: bool = False) -> DataFrame:
    """Records and persons of each code; by: year and/or sex. repeats: a code that the list holds several times counts its records as often."""
    codes = ids.select("concept_id")
    e = c.events(domain).join(codes if repeats else codes.distinct(), "concept_id").withColumn("year", F.year("start_date"))
    if "sex" in by:
        e = e.join(c["person"].select("person_id", F.when(F.col("gender_concept_id") == 8507, "Male").otherwise("Female").alias("sex")), "person_id")
    return e.groupBy("concept_id", *by).agg(F.count("*").alias("n_records"), F.count_distinct("person_id").alias("n_persons"))


def orphan_codes(c: Clinical, ids: DataFrame, domain: str = "drug") -> DataFrame:
    """Relatives in use that the codelist lacks: descendants of its codes' ancestors."""
    up = c["concept_ancestor"].join(ids.select(F.col("concept_id").alias("descendant_concept_id")), "descendant_concept_id").select("ancestor_concept_id").distinct()
    near = c["concept_ancestor"].join(up, "ancestor_concept_id").select(F.col("descendant_concept_id").alias("concept_id")).distinct()
    return code_use(c, near.join(ids, "concept_id", "left_anti"), domain)


def ancestors(c: Clinical, ids: Sequence[int], include_self: bool = True) -> DataFrame:
    """(descendant_concept_id, concept_id, concept_name) above each id."""
    a = c["concept_ancestor"].where(F.col("descendant_concept_id").isin(list(ids)))
    if not include_self:
        a = a.where("ancestor_concept_id != descendant_concept_id")
    return a.join(c["concept"], a["ancestor_concept_id"] == c["concept"]["concept_id"]).select("descendant_concept_id", "concept_id", "concept_name")


def mapped(c: Clinical, ids: DataFrame, relationship: str = "Maps to") -> DataFrame:
    """(concept_id, mapped_concept_id) over one kind of relationship."""
    r = c["concept_relationship"].where(F.col("relationship_id") == relationship)
    return ids.select("concept_id").distinct().join(r, F.col("concept_id") == F.col("concept_id_1")).select("concept_id", F.col("concept_id_2").alias("mapped_concept_id")).distinct()


def union(*codelists: DataFrame) -> DataFrame:
    """Name-wise union of (name, concept_id)."""
    from functools import reduce

    return reduce(DataFrame.unionByName, [x.select("name", "concept_id") for x in codelists]).distinct()


def intersect(*codelists: DataFrame) -> DataFrame:
    """Name-wise intersection of (name, concept_id): one count of codelists per code, not a chain of joins."""
    from functools import reduce

    tagged = [x.select("name", "concept_id").distinct().withColumn("n", F.lit(1)) for x in codelists]
    return reduce(DataFrame.unionByName, tagged).groupBy("name", "concept_id").agg(F.sum("n").alias("n")).where(F.col("n") == len(codelists)).drop("n")


def codes_in_use(c: Clinical, ids: DataFrame, domains: Sequence[str] = ("drug", "condition", "visit")) -> DataFrame:
    """Codes of a codelist that some record of the domains holds."""
    from functools import reduce

    used = reduce(DataFrame.unionByName, [c.events(d).select("concept_id") for d in domains]).distinct()
    # not a semi-join: that would be pushed into each branch of a codelist that is a union, and the records read once for each
    return ids.join(used, "concept_id").select(ids.columns)


def code_use_with_zeros(c: Clinical, ids: DataFrame, domain: str = "drug") -> DataFrame:
    """Records and persons of every code of the list, 0 for those not in use."""
    return ids.select("concept_id").distinct().join(code_use(c, ids, domain), "concept_id", "left").fillna(0, subset=["n_records", "n_persons"])


def subset_by_domain(c: Clinical, ids: DataFrame, domains: Sequence[str]) -> DataFrame:
    """Codes of the list, each once, with a concept of the domains."""
    return ids.distinct().join(c["concept"].where(F.lower("domain_id").isin([d.lower() for d in domains])), "concept_id", "left_semi")
