"""Transitive lookups over small type graphs, as recursive SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def closest_ancestor(types: DataFrame, mapping: DataFrame, most_depth: int = 128) -> DataFrame:
    """(type, representation, distance): the nearest type up the chain of bases that has a mapping.

    ``types`` is (type, base), ``mapping`` is (type, representation).
    """
    spark = types.sparkSession
    return spark.sql(
        f"""with recursive up(type, at, distance) as (
              select type, type, 0 from {{types}}
              union all
              select u.type, t.base, u.distance + 1 from up u join {{types}} t on t.type = u.at
              where t.base is not null and u.distance < {int(most_depth)})
            select u.type, min_by(m.representation, u.distance) as representation, min(u.distance) as distance
            from up u join {{mapping}} m on m.type = u.at group by u.type""",
        types=types, mapping=mapping,
    )


def substitution_members(elements: DataFrame) -> DataFrame:
    """(head, member): all elements that may stand for a head, at any remove. ``elements`` is (name, head)."""
    return elements.sparkSession.sql(
        """with recursive reach(head, member) as (
             select head, name from {elements} where head is not null
             union all
             select r.head, e.name from reach r join {elements} e on e.head = r.member)
           select distinct head, member from reach""",
        elements=elements,
    )


def builtin_base(types: DataFrame) -> DataFrame:
    """(type, builtin): the first base with the prefix ``xs:`` up the chain."""
    return types.sparkSession.sql(
        """with recursive up(type, at, distance) as (
             select type, base, 1 from {types} where base is not null
             union all
             select u.type, t.base, u.distance + 1 from up u join {types} t on t.type = u.at
             where t.base is not null and not u.at like 'xs:%' and u.distance < 128)
           select type, min_by(at, distance) as builtin from up where at like 'xs:%' group by type""",
        types=types,
    )


def union_types(types: DataFrame) -> DataFrame:
    """(type, is_union): whether the type or any of its bases is a union, from (type, base, variety)."""
    return types.sparkSession.sql(
        """with recursive t as (select * from {types}),
        up(type, at, depth) as (select type, type, 0 from t union all select up.type, t.base, depth + 1 from up join t on t.type = up.at where t.base is not null and depth < 128)
        select up.type, bool_or(t.variety = 'union') as is_union from up join t on t.type = up.at group by up.type""",
        types=types,
    )


def with_subtypes(types: DataFrame) -> DataFrame:
    """(type, has_subtypes): whether any named type is derived from it, from (type, base, named)."""
    derived = types.where("named").select(F.col("base").alias("type")).distinct().withColumn("_d", F.lit(True))
    return types.select("type").join(derived, "type", "left").select("type", F.coalesce("_d", F.lit(False)).alias("has_subtypes"))
