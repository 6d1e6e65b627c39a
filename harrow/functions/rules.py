"""Service classification and tags as Column expressions over (module, source file)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Service, category, tokens; the first rule with a token in the text decides.
RULES: list[tuple[str, str, list[str]]] = [
    ("nova", "compute", ["nova"]),
    ("cinder", "storage", ["cinder"]),
    ("ovn", "networking", ["ovn", "openvswitch", "ovs"]),
    ("neutron", "networking", ["neutron"]),
    ("keystone", "identity", ["keystone"]),
    ("glance", "image", ["glance"]),
    ("placement", "placement", ["placement"]),
    ("swift", "object-storage", ["swift"]),
    ("heat", "orchestration", ["heat"]),
    ("horizon", "dashboard", ["horizon"]),
    ("ironic", "baremetal", ["ironic"]),
    ("manila", "shared-filesystems", ["manila"]),
    ("octavia", "load-balancing", ["octavia"]),
    ("barbican", "key-management", ["barbican"]),
    ("ceilometer", "telemetry", ["ceilometer"]),
    ("gnocchi", "telemetry", ["gnocchi"]),
    ("aodh", "telemetry", ["aodh"]),
    ("tripleo", "deployment", ["tripleo", "director"]),
    ("podman", "container-runtime", ["podman", "container"]),
]
#: Tokens that only admit command captures.
COMMAND_ONLY = ["ip_", "ip-", "ip.", "hostname", "systemctl", "ss_", "ss-"]
#: Tag and the words, one of which its text must hold.
TAG_WORDS = [("containerized", ["container", "podman"]), ("networking", ["ovn", "neutron", "networking"]), ("compute", ["nova", "compute"]), ("storage", ["cinder", "storage"]), ("tripleo", ["tripleo"])]


def any_of(text: Column, tokens: list[str]) -> Column:
    """Whether text holds one of the tokens: one regular-expression scan."""
    return text.rlike("|".join(re.escape(t) for t in tokens))


def _tag_set(rank: int, found: int) -> str:
    """The sorted, comma-joined tags of a rule (or of none, rank len(RULES)), found having a bit for each of TAG_WORDS in module and source file."""
    service, category = RULES[rank][:2] if rank < len(RULES) else ("unknown", "unknown")
    tags = {"openstack", "rhosp17"} | ({service} if service != "unknown" else set())
    for i, (tag, words) in enumerate(TAG_WORDS):
        if found >> i & 1 or any(w in f"{service} {category}" for w in words):
            tags.add(tag)
    return ",".join(sorted(tags))


def enrich(df: DataFrame, module: str, source_file: str = "source_file") -> DataFrame:
    """df with service, category (of the first rule with a token in module and source file, or unknown) and tags.

    No token has a blank, so it stands in one of the parts of a text that blanks join: what the words of service and category add to the
    tags depends on the rule alone. A row needs one text, its scans, and a look into three small tables of literals.
    """
    df = df.withColumn("_low", F.lower(F.concat_ws(" ", F.col(module), F.col(source_file))))
    low, chain, none = F.col("_low"), F, len(RULES)
    for rank, (_, _, tokens) in enumerate(RULES):
        chain = chain.when(any_of(low, tokens), F.lit(rank))
    bits = [F.when(any_of(low, words), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, words) in enumerate(TAG_WORDS)]
    df = df.withColumns({"_rank": chain.otherwise(F.lit(none)), "_bits": sum(bits[1:], bits[0])})
    table = lambda values: F.array(*(F.lit(v) for v in values))
    sets = table(_tag_set(rank, found) for rank in range(none + 1) for found in range(1 << len(TAG_WORDS)))
    named = {"service": table([*(s for s, _, _ in RULES), "unknown"])[F.col("_rank")], "category": table([*(c for _, c, _ in RULES), "unknown"])[F.col("_rank")]}
    return df.withColumns(named | {"tags": sets[F.col("_rank") * (1 << len(TAG_WORDS)) + F.col("_bits")]}).drop("_low", "_rank", "_bits")


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, s, c, t) for i, (s, c, t) in enumerate(RULES)], "rank int, service string, category string, tokens array<string>")


def log_tokens() -> list[str]:
    return sorted({t for _, _, ts in RULES for t in ts})


def command_tokens() -> list[str]:
    return [*log_tokens(), *COMMAND_ONLY]
