"""Label expressions: binary block labels and attack-class names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from anomaloom.functions.text import contains_any, normalize_label

# --- fixed values ---------------------------------------------------------------------------
NORMAL_WORDS = ("normal", "0", "false", "no", "benign")
ANOMALY_WORDS = ("anomaly", "anomalous", "1", "true", "yes", "attack")
HEADER_WORDS = ("label", "labels", "class", "attack")

FINE_CLASSES = (
    "Benign",
    "Botnet",
    "Brute Force-FTP",
    "Brute Force-SSH",
    "DDoS-HOIC",
    "DDoS-LOIC-HTTP",
    "DDoS-LOIC-UDP",
    "DoS-GoldenEye",
    "DoS-Hulk",
    "DoS-SlowHTTPTest",
    "DoS-Slowloris",
    "Infiltration",
    "Web Attack-Brute Force",
    "Web Attack-SQL Injection",
    "Web Attack-XSS",
)
FAMILY_CLASSES = (
    "Benign",
    "DDoS",
    "DoS",
    "BruteForce",
    "WebAttack",
    "Botnet",
    "Infiltration",
    "OtherAttack",
)
BINARY_CLASSES = ("Benign", "Anomaly")

# Class -> word groups; a label takes the first class of which every group has a word in it.
FINE_RULES = (
    ("Benign", (("benign",),)),
    ("DDoS-HOIC", (("ddos",), ("hoic",))),
    ("DDoS-LOIC-UDP", (("ddos",), ("loic",), ("udp",))),
    ("DDoS-LOIC-HTTP", (("ddos",), ("loic",), ("http",))),
    ("DoS-Hulk", (("hulk",),)),
    ("DoS-GoldenEye", (("goldeneye",),)),
    ("DoS-Slowloris", (("slowloris",),)),
    ("DoS-SlowHTTPTest", (("slowhttp",),)),
    ("Brute Force-FTP", (("ftp",), ("brute", "patator"))),
    ("Brute Force-SSH", (("ssh",), ("brute", "patator"))),
    ("Web Attack-XSS", (("xss",),)),
    ("Web Attack-SQL Injection", (("sql",), ("inject",))),
    ("Web Attack-Brute Force", (("web",), ("brute",))),
    ("Infiltration", (("infiltration", "infilteration"),)),
    ("Botnet", (("bot",),)),
)
# Start of the fine class -> family.
FAMILY_OF_START = (
    ("DDoS-", "DDoS"),
    ("DoS-", "DoS"),
    ("Brute Force", "BruteForce"),
    ("Web Attack", "WebAttack"),
    ("Botnet", "Botnet"),
    ("Infiltration", "Infiltration"),
    ("Benign", "Benign"),
)
# --------------------------------------------------------------------------------------------

LABEL_SCHEMAS = ("binary", "family", "fine")


def check_label_schema(schema: str) -> None:
    if schema not in LABEL_SCHEMAS:
        raise ValueError(f"label schema must be one of {', '.join(LABEL_SCHEMAS)}, got {schema!r}")


def parse_binary_label(col: Column) -> Column:
    """0 for a normal word, 1 for an anomaly word, else null."""
    word = F.lower(normalize_label(col))
    return F.when(word.isin(*NORMAL_WORDS), F.lit(0)).when(word.isin(*ANOMALY_WORDS), F.lit(1))


def compact_label(label: Column) -> Column:
    return F.regexp_replace(F.lower(label), "[^a-z0-9]+", "")


def fine_label(compact: Column) -> Column:
    """Fine attack class of a compact label; null if unknown."""
    chain = F.when(compact == "normal", F.lit("Benign"))
    for name, groups in FINE_RULES:
        holds = reduce(lambda left, right: left & right, (contains_any(compact, words) for words in groups))
        chain = chain.when(holds, F.lit(name))
    return chain


def family_label(fine: Column) -> Column:
    """Attack family of a fine class; an unknown or absent class is OtherAttack."""
    return F.coalesce(
        *(F.when(fine.startswith(start), F.lit(family)) for start, family in FAMILY_OF_START),
        F.lit("OtherAttack"),
    )
