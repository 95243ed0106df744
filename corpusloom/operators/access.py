"""Who may see and write what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import tables


def effective_groups(level: Column, groups: Column, creator: Column) -> Column:
    """The groups of a new collection by its access level, each once, in order."""
    own = F.array(creator)
    given = F.coalesce(groups, F.array().cast("array<string>"))
    chosen = F.when(level == "private", own).when(level == "group_only", F.concat(given, own)).when(level == "admin", F.concat(F.array(F.lit("admin")), own)).otherwise(F.concat(F.array(F.lit("public")), own))
    return F.array_distinct(chosen)


def groups_are_given(level: Column, groups: Column) -> Column:
    """False where group_only comes without groups."""
    return (level != "group_only") | (F.coalesce(F.size(groups), F.lit(0)) > 0)


def missing_roles(requested: Column, existing: Column) -> Column:
    return F.array_except(requested, existing)


def users_with_roles(grants: DataFrame) -> DataFrame:
    return grants.groupBy("user").agg(F.array_sort(F.collect_set("role")).alias("roles"))


def may_write(users: DataFrame, collections: DataFrame) -> DataFrame:
    """(user, collection) pairs whose roles meet; a user or a collection without any meets nothing."""
    roles = users.select("user", F.explode("roles").alias("g"))
    groups = collections.select("collection", F.explode("security_group").alias("g"))
    return roles.join(groups.hint("merge"), "g").select("user", "collection").distinct()


def visible_chunks(principals: DataFrame, chunks: DataFrame) -> DataFrame:
    """(user, id): every chunk that each of many users may see, by an equality join on the group."""
    roles = principals.select("user", F.explode("roles").alias("g")).distinct()
    groups = chunks.select("id", F.explode("security_group").alias("g")).distinct()
    return groups.join(roles.hint("merge"), "g").select("user", "id").distinct()


def set_number(groups: Column) -> Column:
    """The number of a set of groups, whatever their order; null for none."""
    once = F.array_sort(F.array_distinct(F.filter(groups, lambda g: g.isNotNull())))
    return F.when(F.size(once) > 0, F.xxhash64(once))


def group_sets(chunks: DataFrame) -> DataFrame:
    """(set, groups, n): the distinct sets of groups and the chunks of each; far fewer than chunks, and counted before they are shuffled."""
    once = F.array_sort(F.array_distinct(F.filter("security_group", lambda g: g.isNotNull())))
    return chunks.select(set_number(F.col("security_group")).alias("set"), once.alias("groups")).where("set is not null").groupBy("set").agg(F.first("groups").alias("groups"), F.count("*").alias("n"))


def visible_sets(principals: DataFrame, sets: DataFrame) -> DataFrame:
    """(user, set): the sets that each of many users may see. A chunk carries its ``set_number``, so who sees it is a look-up, and no group is a key that most chunks share."""
    roles = principals.select("user", F.explode("roles").alias("g")).distinct()
    return sets.select("set", F.explode("groups").alias("g")).join(roles.hint("merge"), "g").select("user", "set").distinct()


def visible_counts(principals: DataFrame, chunks: DataFrame) -> DataFrame:
    """(user, n): how many chunks each user sees, from the sets alone; users who see none are left out."""
    sets = tables.cut(group_sets(chunks))
    return visible_sets(principals, sets).join(sets.select("set", "n").hint("merge"), "set").groupBy("user").agg(F.sum("n").alias("n"))


def required_roles(privileges: DataFrame, collections: DataFrame) -> DataFrame:
    """(collection, roles): the known roles among the groups of each collection."""
    groups = collections.select("collection", F.explode("security_group").alias("role"))
    return groups.join(privileges.select("role").distinct().hint("merge"), "role").groupBy("collection").agg(F.array_sort(F.collect_set("role")).alias("roles"))
