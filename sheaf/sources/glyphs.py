"""Repair of private-use characters in text from PDF fonts, given the outlines of the fonts' glyphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.storage import stored

#: SHA-256 of glyph outlines that were verified by eye, and the code points they stand for.
VERIFIED = {
    "52591eb21a9c374fa82aa681f7eb9b019de4c893d49cbc745c3740a890eb230c": 3657,
    "0fa641fde2abff437f3b6b436c4b98f853be57ab1c7cd62183a27b98e39458b7": 3638,
    "12945c6f46081a276f80c6ae37c292edaa2c14e60820555a62a4f6e3f453cf73": 3655,
    "2b0e509438d7e90414897d5a69271862ccfdbba78048b51573c45d1cce83c99a": 3656,
    "46fc02597ea4b50954d13883e488d418a0a7510452545cdd6cac9df2362d9e56": 3656,
    "4b34da2738d35073e75e16b0c04ef7977b2a9fc697ecef87be56a37f44d212a5": 3660,
    "50ecc347d4bd017eafede210fbe86c32e2442af5efd0e74710b9e65014086c61": 3657,
    "59e068551c8942ba01ad958d3ebce83910c5986ca346113fdb169f4471ed05b9": 3656,
    "6c96d002b83b0cb3db40753608bb657243cfcebdc47b9f49caf47c217a5bf6ef": 3633,
    "6df34488185ff36431c0e89568186aef16e59945f3776964af5dd412bba7aac6": 3633,
    "7a9d3298c027f8542dd4bd56937cfb6019b7104771846ee2d917bb68c96f1b6e": 3657,
    "86cee227bdd8fbe51e29dbaf69a35355646faaf2ba673de356ea832db54c5782": 3656,
    "8c756db1fb4ebeb2afb8006a7a29a3963f88df521673f8cf73799c5984f171f3": 3655,
    "907b462336fbbd28cc61a4891ecbd41727afb17ef062abadcffcc95b9bff12d0": 3660,
    "9269bc18f766a51fa32ccefc414e226a687d2f9163bf58d783041252cc3069c4": 3657,
    "9b592591bd8f6dc820e8ef30dd749c433f4f3a0fdd9cb43973dd6afa2b433b5e": 3636,
    "9df82d6fe72a11d96127b62ce5888770072e749d663d8ea99ecd1b94686bb26f": 3658,
    "a824d6a8fefe1f181ed790bb2d004a956ffd08b8a2ae7b43ee1c07c33262f0ca": 3636,
    "b59c0cac6684a69aa4d89295e8f82a8bb721c5452c7f105b6a4d5ceb2110c1ba": 3637,
    "bd6e72332da0131c54cfa418a0eebdc172e482a6417fdb920a1da5be601e33d1": 3660,
    "d8cfb30ffa7be69d42479be7fb3f9b13104f03e7238b110c086434a79f0afd04": 3660,
    "e04418b746fbb6bcfad247b212a2cecb2e25545dd530fa05914f3b843b3d74ce": 3637,
    "ec9470ea3bfd0f6a4d02f0117d4204c3f357e9904466a7f493f2acf90daf31b3": 3657,
    "f37d77d776086689a3de1ff0e8d27b71f74bc0901ccf001fe58f6a45b57dd77a": 3638,
}
#: Fixed value: how the names of the fonts begin whose private codes may be repaired.
FAMILY = "THSarabun"


def verified(spark: SparkSession) -> DataFrame:
    """The verified outlines as a table (outline, target)."""
    return spark.createDataFrame(list(VERIFIED.items()), "outline string, target int")


def glyph_map(glyphs: DataFrame, verified: DataFrame | None = None, family: str = "") -> DataFrame:
    """(family, code, target) from glyphs (family, outline, code): private codes whose outline stands for exactly one Thai code.

    What an outline stands for are the Thai codes that the fonts of the family give it and those of ``verified`` (outline,
    target).  An outline with several targets, or a code whose outlines have several, isn't guessed.  Only families whose
    name begins with ``family`` are read.
    """
    own = glyphs.filter(F.startswith("family", F.lit(family)))
    private = own.filter(F.col("code").between(0xE000, 0xF8FF)).select("family", "outline", "code").distinct()
    targets = own.filter(F.col("code").between(0x0E01, 0x0E4E)).select("family", "outline", F.col("code").alias("target"))
    if verified is not None:
        targets = targets.unionByName(private.join(verified, "outline").select("family", "outline", "target"))
    only = lambda name: F.when(F.min(name) == F.max(name), F.min(name)).alias(name)
    known = targets.groupBy("family", "outline").agg(only("target")).filter("target IS NOT NULL")
    return private.join(known, ["family", "outline"]).groupBy("family", "code").agg(only("target")).filter("target IS NOT NULL")


def character(code: Column) -> Column:
    """The character of a code point below 0x10000."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")


def repair(texts: DataFrame, mapping: DataFrame) -> DataFrame:
    """Texts (family, text) with mapped characters replaced; all others, and texts of other families, stay.

    A family has at most 6,400 private codes, so its mapping is one small string for ``translate``.  The mappings are stored, so that
    their size is known: Spark broadcasts them, and texts, of which many have the same family or none, stay where they are.
    """
    ordered = F.array_sort(F.collect_list(F.struct("code", "target")))
    side = lambda name: F.array_join(F.transform("pairs", lambda p: character(p[name])), "")
    pairs = stored(mapping.groupBy("family").agg(ordered.alias("pairs")).select("family", side("code").alias("_from"), side("target").alias("_to")), "glyphs")
    return texts.join(pairs, "family", "left").withColumn("text", F.coalesce(F.call_function("translate", F.col("text"), F.col("_from"), F.col("_to")), "text")).drop("_from", "_to")
