"""Code lists with a completeness flag: those that rules come with, and a scan of list files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CodeList:
    list_id: str
    codes: tuple[str, ...]
    complete: bool = False

    def may_deny(self) -> bool:
        """A partial list may confirm a code, never deny it."""
        return self.complete


# Tax categories (a closed list), active currencies and document types (both amended now and then).
TAX_CATEGORIES = "AE E G K L M O S Z"
CURRENCIES = """
AED AFN ALL AMD ANG AOA ARS AUD AWG AZN BAM BBD BDT BGN BHD BIF BMD BND BOB BRL BSD BTN BWP BYN BZD CAD CDF CHF CLP CNY COP CRC CUP CVE CZK
DJF DKK DOP DZD EGP ERN ETB EUR FJD FKP GBP GEL GHS GIP GMD GNF GTQ GYD HKD HNL HTG HUF IDR ILS INR IQD IRR ISK JMD JOD JPY KES KGS KHR KMF
KPW KRW KWD KYD KZT LAK LBP LKR LRD LSL LYD MAD MDL MGA MKD MMK MNT MOP MRU MUR MVR MWK MXN MYR MZN NAD NGN NIO NOK NPR NZD OMR PAB PEN PGK
PHP PKR PLN PYG QAR RON RSD RUB RWF SAR SBD SCR SDG SEK SGD SHP SLE SOS SRD SSP STN SVC SYP SZL THB TJS TMT TND TOP TRY TTD TWD TZS UAH UGX
USD UYU UZS VED VES VND VUV WST XAF XCD XCG XDR XOF XPF XXX YER ZAR ZMW ZWG
"""
DOCUMENT_TYPES = """
71 80 82 84 102 130 202 203 204 211 218 219 295 325 326 331 380 381 382 383 384 385 386 387 388 389 390 393 394 395 396 420 456 457 458 527
532 553 575 623 633 751 780 817 870 875 876 877 935
"""
#: Units in everyday use. The full recommendation has some 1,800 codes: give its file to ``load_code_lists``.
COMMON_UNITS = "C62 DAY EA GRM H87 HUR KGM KMT KWH LTR MTK MTQ MTR TNE XBX XPK"

LISTS = {x.list_id: x for x in (
    CodeList("ISO4217", tuple(CURRENCIES.split())), CodeList("UNCL1001", tuple(DOCUMENT_TYPES.split())), CodeList("UNECE_REC20", tuple(COMMON_UNITS.split())),
    CodeList("UNTDID5305", tuple(TAX_CATEGORIES.split()), complete=True),
)}


def scan_code_lists(spark: SparkSession, path: str) -> DataFrame:
    """list_id, complete and code of every JSON list file (list_id, completeness, codes) under ``path``."""
    files = spark.read.schema("list_id string, completeness string, codes array<string>").option("multiLine", True).json(path)
    return files.select("list_id", (F.col("completeness") == "complete").alias("complete"), F.explode("codes").alias("code"))


def load_code_lists(spark: SparkSession, path: str) -> dict[str, CodeList]:
    """The lists under ``path`` in place of those of the same id that rules come with. A list is some thousand codes at most."""
    rows = scan_code_lists(spark, path).groupBy("list_id", "complete").agg(F.array_sort(F.collect_set("code")).alias("codes")).collect()
    return LISTS | {r.list_id: CodeList(r.list_id, tuple(r.codes), bool(r.complete)) for r in rows}


def code_rows(spark: SparkSession, lists: dict[str, CodeList]) -> DataFrame:
    """list_id and code of ``lists``."""
    return spark.createDataFrame([(x.list_id, c) for x in lists.values() for c in x.codes], "list_id string, code string")


def unused_lists(lists: DataFrame, rules: DataFrame) -> DataFrame:
    """list_id of lists (list_id, file) whose file name stands in no rule text (text) of their profile; both sides are small."""
    named = lists.alias("l").join(F.broadcast(rules.alias("r")), (F.col("l.profile") == F.col("r.profile")) & F.contains(F.col("r.text"), F.col("l.file")), "left_anti")
    return named.select("profile", "list_id")
