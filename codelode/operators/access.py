"""Who may do what: key access, role checks, provider choice, user listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.functions.text import key_role, role_rank
from codelode.operators.fanout import every_pair


def key_access(keys: DataFrame, members: DataFrame, as_of: Column) -> DataFrame:
    """api_key_id, project_id and effective_role of every live key.

    keys (api_key_id, key_type, role, is_active, expires_at, project_id, created_by), members (user_id, project_id, role). A project
    key has its own role; a personal one, per project of its owner, the lesser of its role and what the membership gives. Unknown
    roles give nothing.
    """
    live = keys.where(F.col("is_active") & (F.col("expires_at").isNull() | (F.col("expires_at") > as_of)) & (role_rank(F.col("role"), "key") > 0))
    own = live.where("key_type = 'project'").select("api_key_id", "project_id", F.col("role").alias("effective_role"))
    by_member = live.where("key_type = 'personal'").select("api_key_id", "created_by", F.col("role").alias("key_role"))
    given = members.select(F.col("user_id").alias("created_by"), "project_id", role_rank(key_role(F.col("role")), "key").alias("given")).where("given > 0")
    held = by_member.select("created_by", "api_key_id", role_rank(F.col("key_role"), "key").alias("held"))
    personal = every_pair(held, given, ["created_by"])  # an owner's keys and memberships may both be many
    return own.unionByName(personal.select("api_key_id", "project_id", F.when(F.least("held", "given") == 2, "write").otherwise("read").alias("effective_role")))


def effective_role(is_admin: Column, member_role: Column) -> Column:
    """Platform admins act as owners; others have their membership, null if none."""
    return F.when(is_admin, "owner").when(role_rank(member_role) > 0, member_role)


def sufficient(role: Column, required: str) -> Column:
    """Whether a role is at least the one required; unknown roles never are."""
    need = role_rank(F.lit(required))
    return F.coalesce((need > 0) & (role_rank(role) >= need), F.lit(False))


def resolve_provider(projects: DataFrame, configs: DataFrame) -> DataFrame:
    """project_id, config_id and origin: the project's own active config, else its chosen global one if usable, else the default.

    projects (project_id, selected_id), configs (config_id, project_id, is_active, is_default).
    """
    live = configs.where("is_active")
    own = live.where("project_id is not null").groupBy("project_id").agg(F.max("config_id").alias("own_id"))
    shared = live.where("project_id is null")
    chosen = shared.select(F.col("config_id").alias("chosen_id"))
    default = shared.where("is_default").agg(F.max("config_id").alias("default_id"))
    out = projects.join(own, "project_id", "left").join(chosen, F.col("selected_id") == F.col("chosen_id"), "left").crossJoin(F.broadcast(default))  # one row
    origin = F.when(F.col("own_id").isNotNull(), "custom").when(F.col("chosen_id").isNotNull(), "selected").when(F.col("default_id").isNotNull(), "default")
    return out.select("project_id", F.coalesce("own_id", "chosen_id", "default_id").alias("config_id"), origin.alias("origin"))


def list_users(users: DataFrame, members: DataFrame, roles: DataFrame) -> DataFrame:
    """users with project_count and platform_roles (sorted, empty if none)."""
    counts = members.groupBy("user_id").agg(F.count("*").alias("project_count"))
    held = roles.groupBy("user_id").agg(F.array_sort(F.collect_set("role")).alias("platform_roles"))  # a handful of roles a user
    out = users.join(counts, "user_id", "left").join(held, "user_id", "left")
    return out.withColumn("project_count", F.coalesce("project_count", F.lit(0))).withColumn("platform_roles", F.coalesce("platform_roles", F.array().cast("array<string>")))
