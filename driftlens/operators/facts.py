"""Typed facts of texts (interfaces, ports, runnables, events, access points, calibration objects) and their differences."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.functions import names

# XML tags that define what is summarised.
INTERFACES = set("SENDER-RECEIVER-INTERFACE CLIENT-SERVER-INTERFACE MODE-SWITCH-INTERFACE NV-DATA-INTERFACE PARAMETER-INTERFACE TRIGGER-INTERFACE".split())
COMPONENTS = set(
    "APPLICATION-SW-COMPONENT-TYPE SENSOR-ACTUATOR-SW-COMPONENT-TYPE COMPLEX-DEVICE-DRIVER-SW-COMPONENT-TYPE SERVICE-SW-COMPONENT-TYPE ECU-ABSTRACTION-SW-COMPONENT-TYPE NV-BLOCK-SW-COMPONENT-TYPE".split()
)
PORTS = {"P-PORT-PROTOTYPE": "P-PORT", "R-PORT-PROTOTYPE": "R-PORT", "PR-PORT-PROTOTYPE": "PR-PORT"}
FACTS = "rel string, parsed boolean, fact_type string, owner string, name string, descr string"


def _tag(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _said(e: ElementTree.Element, *tags: str, suffix: str | None = None) -> str | None:
    """Text of the first child with one of the tags, or whose tag ends so."""
    return next(((c.text or "").strip() for c in e if _tag(c) in tags or suffix and _tag(c).endswith(suffix)), None)


def _component_fact(e: ElementTree.Element) -> tuple[str, str] | None:
    """Type and description of a port, runnable or event."""
    tag = _tag(e)
    if tag in PORTS:
        return "port", f"{PORTS[tag]} {(_said(e, suffix='INTERFACE-TREF') or '').rpartition('/')[2]}".strip()
    if tag == "RUNNABLE-ENTITY":
        return "runnable", _said(e, "SYMBOL") or ""
    if tag.endswith("-EVENT"):
        period, on = _said(e, "PERIOD"), _said(e, "START-ON-EVENT-REF")
        return "event", tag.removesuffix("-EVENT") + (f" {period}s" if period else "") + ("" if on is None else f" on {on.rpartition('/')[2]}")
    return None


def xml_rows(text: str) -> list[tuple[str, str | None, str, str]]:
    """(fact_type, owner, name, descr) of an XML text, from one walk with the packages and component above in hand."""
    out: dict[tuple[str, str | None, str], str] = {}
    todo = [(ElementTree.fromstring(text), (), None, False)]
    while todo:
        e, packages, owner, inside = todo.pop()
        tag, name = _tag(e), _said(e, "SHORT-NAME")
        path = "/" + "/".join((*packages, name or ""))
        if owner and (fact := _component_fact(e)):
            if name:
                out[fact[0], owner, name] = fact[1]
            continue
        if tag in INTERFACES and not inside:
            if name:
                out["iface", None, path] = tag
            # Its body defines no interfaces, but components are looked for everywhere.
            inside = True
        if tag in COMPONENTS and owner is None:
            owner = path if name else ""  # below a component without a name no other is looked for
            if name:
                out["swc", None, path] = ""
        if tag == "AR-PACKAGE" and name:
            packages = (*packages, name)
        todo += [(c, packages, owner, inside) for c in reversed(e)]
    return [(*k, v) for k, v in out.items()]


def xml_facts(files: DataFrame) -> DataFrame:
    """FACTS of XML files (rel, text). A file that doesn't parse has one row with parsed false; one without facts none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for rel, text in zip(b.rel, b.text, strict=True):
                try:
                    rows += [(rel, True, *r) for r in xml_rows(text)]
                except ElementTree.ParseError:
                    rows.append((rel, False, None, None, None, None))
            yield pd.DataFrame(rows, columns=["rel", "parsed", "fact_type", "owner", "name", "descr"])

    return files.select("rel", "text").mapInPandas(run, FACTS)


def rte_facts(files: DataFrame) -> DataFrame:
    """Access points of C files (rel, text)."""
    return files.where(F.col("rel").endswith(".c")).select("rel", F.explode(names.rte_calls(F.col("text"))).alias("name")).select("rel", F.lit(True).alias("parsed"), F.lit("rte").alias("fact_type"), F.lit(None).cast("string").alias("owner"), "name", F.lit("").alias("descr"))


def a2l_facts(files: DataFrame) -> DataFrame:
    """Calibration objects of A2L files (rel, text); of equal names the last kind."""
    rows = files.where(F.lower("rel").endswith(".a2l")).select("rel", F.posexplode(names.a2l_objects(F.col("text"))).alias("pos", "o"))
    last = rows.groupBy("rel", F.col("o.name").alias("name")).agg(F.max_by("o.kind", "pos").alias("descr"))
    return last.select("rel", F.lit(True).alias("parsed"), F.lit("a2l").alias("fact_type"), F.lit(None).cast("string").alias("owner"), "name", "descr")


def text_facts(files: DataFrame) -> DataFrame:
    """rte_facts and a2l_facts of files in one pass over their texts."""
    none = F.array().cast("array<struct<fact_type:string,name:string,descr:string>>")
    rte = F.transform(names.rte_calls(F.col("text")), lambda x: F.struct(F.lit("rte").alias("fact_type"), x.alias("name"), F.lit("").alias("descr")))
    a2l = F.transform(names.a2l_objects(F.col("text")), lambda o: F.struct(F.lit("a2l").alias("fact_type"), o["name"].alias("name"), o["kind"].alias("descr")))
    found = F.when(F.col("rel").endswith(".c"), rte).when(F.lower("rel").endswith(".a2l"), a2l).otherwise(none)
    rows = files.select("rel", F.posexplode(found).alias("pos", "f")).groupBy("rel", "f.fact_type", "f.name").agg(F.max_by("f.descr", "pos").alias("descr"))
    return rows.select("rel", F.lit(True).alias("parsed"), "fact_type", F.lit(None).cast("string").alias("owner"), "name", "descr")


def fact_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """change (+, -, ~), old and new description of facts. A file with a side that doesn't parse gives none.

    Kinds of interfaces and calibration objects may change unsaid; descriptions of the others are compared.
    """
    key = ["rel", "fact_type", "owner", "name"]
    broken = old.where("not parsed").select("rel").union(new.where("not parsed").select("rel")).distinct()
    a = old.where("parsed").select(*key, F.col("descr").alias("old_descr")).alias("a")
    b = new.where("parsed").select(*key, F.col("descr")).alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key]
    both = a.join(b, on=same[0] & same[1] & same[2] & same[3], how="full_outer")
    cols = [F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in key]
    change = F.when(F.col("a.rel").isNull(), "+").when(F.col("b.rel").isNull(), "-").when(F.coalesce("a.fact_type", "b.fact_type").isin("port", "runnable", "event") & (F.col("old_descr") != F.col("descr")), "~")
    found = both.select(*cols, change.alias("change"), "old_descr", "descr").where("change is not null")
    return found.join(broken, "rel", "left_anti")
