"""Who may do and see what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Roles, permissions and which role holds which.
PERMISSIONS = [
    "camera:read", "camera:write", "camera:delete", "department:read", "department:write", "stream:view",
    "watchlist:read", "watchlist:write", "alert:read", "alert:acknowledge", "alert:escalate", "alert:resolve",
    "evidence:read", "evidence:export", "user:read", "user:write", "audit:read", "integration:query", "analytics:control",
]
ROLE_PERMISSIONS = {
    "state_admin": PERMISSIONS,
    "department_admin": [
        "camera:read", "camera:write", "department:read", "stream:view", "watchlist:read", "watchlist:write", "alert:read",
        "alert:acknowledge", "alert:escalate", "alert:resolve", "evidence:read", "user:read", "audit:read", "integration:query",
    ],
    "control_room_operator": [
        "camera:read", "department:read", "stream:view", "watchlist:read", "alert:read", "alert:acknowledge", "alert:escalate",
        "evidence:read",
    ],
    "investigator": [
        "camera:read", "department:read", "stream:view", "watchlist:read", "watchlist:write", "alert:read", "alert:acknowledge",
        "alert:escalate", "alert:resolve", "evidence:read", "evidence:export", "integration:query",
    ],
    "auditor": [
        "camera:read", "department:read", "watchlist:read", "alert:read", "evidence:read", "user:read", "audit:read",
    ],
}
STATE_WIDE_ROLES = ["state_admin", "auditor"]


def permission_matrix(spark: SparkSession) -> DataFrame:
    rows = [(role, p) for role, held in ROLE_PERMISSIONS.items() for p in held]
    return spark.createDataFrame(rows, "role string, permission string")


def is_state_wide(role: Column) -> Column:
    return role.isin(STATE_WIDE_ROLES)


def users_with(users: DataFrame, permissions: list[str]) -> DataFrame:
    """Active users whose role holds every one of the permissions."""
    roles = [r for r, held in ROLE_PERMISSIONS.items() if all(p in held for p in permissions)]
    return users.where(F.col("active") & F.col("role").isin(roles))


def visible_to(rows: DataFrame, role: str, department_id: str | None) -> DataFrame:
    """The rows one user may see: everything state-wide, otherwise their own department's."""
    if role in STATE_WIDE_ROLES:
        return rows
    return rows.where(F.col("department_id") == F.lit(department_id))


def visible_counts(users: DataFrame, rows: DataFrame) -> DataFrame:
    """How many rows each active user may see. Rows are counted per department before users are joined."""
    per_department = rows.where(F.col("department_id").isNotNull()).groupBy("department_id").agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("n")).select(F.lit(True).alias("wide"), "n")
    people = users.where("active")
    wide = people.where(is_state_wide(F.col("role"))).withColumn("wide", F.lit(True)).join(total, "wide").drop("wide")
    narrow = people.where(~is_state_wide(F.col("role"))).join(per_department, "department_id", "left")
    return wide.unionByName(narrow).select("username", "role", F.coalesce("n", F.lit(0)).alias("visible"))
