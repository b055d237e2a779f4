"""Labels of the published classification of 75 response clusters, 46 groups and 7 supergroups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epochal.functions import scalars

# Fixed values of the published classification: (cluster id, cluster name, group id).
CLUSTER_ROWS = [
    (1, "1", 1),
    (2, "2", 2),
    (3, "3", 3),
    (4, "4a", 4),
    (5, "4b", 4),
    (6, "5a", 5),
    (7, "5b", 5),
    (8, "5c", 5),
    (9, "6", 6),
    (10, "7", 7),
    (11, "8a", 8),
    (12, "8b", 8),
    (13, "9", 9),
    (14, "10", 10),
    (15, "11a", 11),
    (16, "11b", 11),
    (17, "12a", 12),
    (18, "12b", 12),
    (19, "13", 13),
    (20, "14", 14),
    (21, "15", 15),
    (22, "16", 16),
    (23, "17a", 17),
    (24, "17b", 17),
    (25, "17c", 17),
    (26, "18a", 18),
    (27, "18b", 18),
    (28, "19", 19),
    (29, "20", 20),
    (30, "21", 21),
    (31, "22a", 22),
    (32, "22b", 22),
    (33, "23", 23),
    (34, "24", 24),
    (35, "25", 25),
    (36, "26", 26),
    (37, "27", 27),
    (38, "28a", 28),
    (39, "28b", 28),
    (40, "29", 29),
    (41, "30", 30),
    (42, "31a", 31),
    (43, "31b", 31),
    (44, "31c", 31),
    (45, "31d", 31),
    (46, "31e", 31),
    (47, "32a", 32),
    (48, "32b", 32),
    (49, "32c", 32),
    (50, "33", 33),
    (51, "34a", 34),
    (52, "34b", 34),
    (53, "35a", 35),
    (54, "35b", 35),
    (55, "36", 36),
    (56, "37a", 37),
    (57, "37b", 37),
    (58, "38a", 38),
    (59, "38b", 38),
    (60, "38c", 38),
    (61, "39", 39),
    (62, "40a", 40),
    (63, "40b", 40),
    (64, "41", 41),
    (65, "42a", 42),
    (66, "42b", 42),
    (67, "42c", 42),
    (68, "42d", 42),
    (69, "42e", 42),
    (70, "42f", 42),
    (71, "43", 43),
    (72, "44", 44),
    (73, "45", 45),
    (74, "46a", 46),
    (75, "46b", 46),
]

# Fixed values of the published classification: (group id, group name, supergroup).
GROUP_ROWS = [
    (1, "Off local, OS", "OFF"),
    (2, "Off DS", "OFF"),
    (3, "Off step", "OFF"),
    (4, "Off slow", "OFF"),
    (5, "Off alpha sustained", "OFF"),
    (6, '(On-)Off "JAM-B" mix', "OFF"),
    (7, "Off sustained", "OFF"),
    (8, "Off alpha transient", "OFF"),
    (9, 'Off "mini" alpha transient', "OFF"),
    (10, 'On-Off local-edge "W3"', "ON-OFF"),
    (11, "On-Off local", "ON-OFF"),
    (12, "On-Off DS 1", "ON-OFF"),
    (13, "On-Off DS 2", "ON-OFF"),
    (14, "(On-)Off local, OS", "ON-OFF"),
    (15, "On step", "Fast ON"),
    (16, "On DS transient", "Fast ON"),
    (17, "On local transient, OS", "Fast ON"),
    (18, "On transient", "Fast ON"),
    (19, "On alpha transient", "Fast ON"),
    (20, "On high frequency", "Fast ON"),
    (21, "On low frequency", "Slow ON"),
    (22, "On sustained", "Slow ON"),
    (23, 'On "mini" alpha', "Slow ON"),
    (24, "On alpha sustained", "Slow ON"),
    (25, "On DS sustained 1", "Slow ON"),
    (26, "On DS sustained 2", "Slow ON"),
    (27, "On slow", "Slow ON"),
    (28, "On contrast suppressed", "Slow ON"),
    (29, "On DS sustained 3", "Unc. ON"),
    (30, "On local sustained, OS", "Unc. ON"),
    (31, "Off suppressed 1", "Unc. SbC"),
    (32, "Off suppressed 2", "Unc. SbC"),
    (33, "Off", "dAC"),
    (34, "On high frequency sustained 1", "dAC"),
    (35, "On high frequency transient", "dAC"),
    (36, "On-Off high frequency", "dAC"),
    (37, "On high frequency sustained 2", "dAC"),
    (38, "On sustained 1", "dAC"),
    (39, "On sustained 2", "dAC"),
    (40, "On sustained 3", "dAC"),
    (41, "On sustained 4", "dAC"),
    (42, 'On "starburst"', "dAC"),
    (43, "On-Off local", "dAC"),
    (44, "On step", "dAC"),
    (45, "On local 1", "dAC"),
    (46, "On local 2", "dAC"),
]

CLUSTERS = [name for _, name, _ in CLUSTER_ROWS]
GROUPS = [name for _, name, _ in GROUP_ROWS]
UNKNOWN = "Unknown"


def _nth(names: list[str], i: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, names)), i.cast("int") - 1), F.lit(UNKNOWN))


def cluster_name(cluster_id: Column) -> Column:
    """Name of a cluster id, ``Unknown`` out of range."""
    return _nth(CLUSTERS, cluster_id)


def cluster_id(name: Column) -> Column:
    """Id of a cluster name, -1 if unknown."""
    at = F.array_position(F.array(*map(F.lit, CLUSTERS)), name)
    return F.when(at > 0, at).otherwise(F.lit(-1)).cast("int")


def group_id(cluster: Column) -> Column:
    """Group of a cluster id, -1 out of range."""
    return F.coalesce(F.get(F.array(*[F.lit(g) for _, _, g in CLUSTER_ROWS]), cluster.cast("int") - 1), F.lit(-1))


def group_name(group: Column, short: bool = False) -> Column:
    name = _nth(GROUPS, group)
    return scalars.short_name(name) if short else name


def supergroup(group: Column) -> Column:
    """Supergroup of a group id, ``Unknown`` out of range."""
    return _nth([name for _, _, name in GROUP_ROWS], group)


def table(spark: SparkSession) -> DataFrame:
    """All clusters with their group and supergroup (75 rows)."""
    c = spark.range(1, len(CLUSTERS) + 1).select(F.col("id").cast("int").alias("cluster_id"))
    g = group_id(F.col("cluster_id"))
    return c.select("cluster_id", cluster_name(F.col("cluster_id")).alias("cluster_name"), g.alias("group_id"), group_name(g).alias("group_name"), supergroup(g).alias("supergroup"))
