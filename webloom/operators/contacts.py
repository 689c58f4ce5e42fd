"""Name, address and phone of a site: candidates by page, and whether the pages agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions import contact as C
from webloom.functions import urls as U

CAP = 12  # candidates of a field on a page
# Sources, most to be trusted first.
PRIORITY = {"json_ld": 0, "microdata": 1, "tel_link": 2, "visible_text": 3}
FIELDS = ["name", "address", "phone"]
CONTACT_LIKE = ["contact", "contact-us", "contactus", "about", "about-us", "aboutus", "impressum"]


def normalized(field: Column, raw: Column) -> Column:
    return F.when(field == "phone", C.normalize_phone(raw)).when(field == "address", C.normalize_address(raw)).otherwise(C.normalize_name(raw))


def _priority(source: Column) -> Column:
    out = F.lit(99)
    for k, v in PRIORITY.items():
        out = F.when(source == k, v).otherwise(out)
    return out


def target_business(pages: DataFrame) -> DataFrame:
    """(site, target): the most frequent schema name on root pages, else on all pages; the first seen of equals."""
    names = pages.select("site", "pos", U.is_root_path(F.col("final_url")).alias("root"), F.posexplode(F.filter("values", lambda v: (v["field"] == "name") & v["source"].isin("json_ld", "microdata"))).alias("i", "v"))
    names = names.select("site", "pos", "i", "root", C.normalize_name(F.col("v.raw")).alias("name")).where("name <> ''")
    n = names.groupBy("site", "name").agg(F.count_if("root").alias("on_root"), F.count("*").alias("n"), F.min(F.struct(F.when(F.col("root"), F.col("pos")), "i")).alias("x"), F.min(F.struct("pos", "i")).alias("first"))
    root_first = names.where("root").groupBy("site", "name").agg(F.min(F.struct("pos", "i")).alias("root_first"))
    n = n.drop("x").join(root_first, ["site", "name"], "left")
    score = F.struct((-(F.col("on_root") > 0).cast("int")).alias("a"), (-F.when(F.col("on_root") > 0, F.col("on_root")).otherwise(F.col("n"))).alias("b"), F.coalesce("root_first", "first").alias("c"))
    return n.groupBy("site").agg(F.min_by("name", score).alias("target"))


def candidates(pages: DataFrame, target: DataFrame | None = None) -> DataFrame:
    """(site, pos, page, ord, field, raw_value, normalized_value, source), cut and cleaned page by page."""
    p = pages.select("site", "pos", F.col("final_url").alias("page"), "values", "text")
    p = p.join(target, "site", "left") if target is not None else p.withColumn("target", F.lit(None).cast("string"))
    one = lambda field, raws: F.transform(raws, lambda r: F.struct(F.lit("visible_text").alias("source"), F.lit(None).cast("string").alias("block_name"), F.lit(field).alias("field"), r.alias("raw")))
    seen = F.when(U.is_legal_document(F.col("page")), F.array().cast("array<struct<source:string,block_name:string,field:string,raw:string>>")).otherwise(F.concat(one("phone", C.phones(F.col("text"))), one("address", C.addresses(F.col("text"))), one("name", C.copyright_names(F.col("text")))))
    c = p.select("site", "pos", "page", "target", F.posexplode(F.concat("values", seen)).alias("ord", "v")).select("site", "pos", "page", "target", "ord", "v.*")
    own = F.col("target").isNull() | F.col("block_name").isNull() | (C.strip_legal_suffix(C.normalize_name(F.col("block_name"))) == C.strip_legal_suffix(F.col("target")))
    c = c.where(own).select("site", "pos", "page", "ord", "field", F.col("raw").alias("raw_value"), normalized(F.col("field"), F.col("raw")).alias("normalized_value"), "source").where("normalized_value <> ''")
    w = Window.partitionBy("site", "pos", "page", "field", "normalized_value", "source").orderBy("ord")
    c = c.withColumn("k", F.row_number().over(w)).where("k = 1")
    w = Window.partitionBy("site", "pos", "page", "field")
    c = c.withColumn("k", F.row_number().over(w.orderBy("ord"))).where(F.col("k") <= CAP).drop("k")
    c = c.withColumn("precise", F.max(F.col("source") != "visible_text").over(w))
    return c.where("not precise or source <> 'visible_text'").drop("precise")


def canonical_forms(values: DataFrame) -> DataFrame:
    """values with canonical: for addresses the first, longest form of the site that subsumes the value; else the value itself.

    A site has few distinct addresses, so they are gathered as one array of a row and matched there.
    """
    forms = values.where("field = 'address'").groupBy("site", "normalized_value").agg(F.min(F.struct("pos", "ord")).alias("first"))
    forms = forms.groupBy("site").agg(F.array_sort(F.collect_list(F.struct((-F.size(F.split("normalized_value", " "))).alias("n"), "first", F.col("normalized_value").alias("v")))).alias("forms"))
    none = F.array().cast("array<string>")
    # a form joins the canonical ones unless one of them subsumes it
    step = lambda acc, x: F.when(F.exists(acc, lambda y: C.address_subsumes(y, x["v"])), acc).otherwise(F.concat(acc, F.array(x["v"])))
    forms = forms.select("site", F.aggregate("forms", none, step).alias("canon"))
    out = values.join(forms, "site", "left")
    up = F.get(F.filter("canon", lambda y: C.address_subsumes(y, F.col("normalized_value"))), F.lit(0))
    return out.withColumn("canonical", F.when(F.col("field") == "address", F.coalesce(up, F.col("normalized_value"))).otherwise(F.col("normalized_value"))).drop("canon")


def compare(values: DataFrame, sites: DataFrame) -> DataFrame:
    """Three rows for each site(site): field, pages_compared, values, normalized_values, confidence, verdict, evidence, majority_count, total."""
    c = canonical_forms(values)
    raw = F.min_by("raw_value", F.struct(_priority(F.col("source")).alias("p"), "pos", "ord"))
    per = c.groupBy("site", "field", "canonical").agg(F.count("*").alias("n"), F.min(F.struct("pos", "ord")).alias("first"), raw.alias("raw"))
    per = per.groupBy("site", "field").agg(F.max("n").alias("majority_count"), F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("first", "canonical", "raw"))).alias("forms"))
    # evidence is kept whole: it is the result, and CAP bounds it for each page
    ev = c.groupBy("site", "field").agg(F.array_sort(F.collect_list(F.struct("pos", "ord", "page", "raw_value", "normalized_value", "source"))).alias("e"))
    fields = sites.select("site").distinct().withColumn("field", F.explode(F.array(*[F.lit(f) for f in FIELDS])))
    r = fields.join(per, ["site", "field"], "left").join(ev, ["site", "field"], "left")
    empty = F.array().cast("array<string>")
    e = F.transform("e", lambda x: F.struct(x["page"].alias("page"), x["raw_value"].alias("raw_value"), x["normalized_value"].alias("normalized_value"), x["source"].alias("source")))
    return r.select(
        "site",
        "field",
        F.coalesce(F.array_distinct(F.transform("e", lambda x: x["page"])), empty).alias("pages_compared"),
        F.coalesce(F.transform("forms", lambda x: x["raw"]), empty).alias("values"),
        F.coalesce(F.transform("forms", lambda x: x["canonical"]), empty).alias("normalized_values"),
        F.coalesce(F.bround(F.col("majority_count") / F.col("total"), 4), F.lit(0.0)).alias("confidence"),
        F.when(F.col("total").isNull(), "insufficient_data").when(F.size("forms") == 1, "consistent").otherwise("inconsistent").alias("verdict"),
        F.coalesce(e, F.array().cast("array<struct<page:string,raw_value:string,normalized_value:string,source:string>>")).alias("evidence"),
        F.coalesce("majority_count", F.lit(0)).cast("long").alias("majority_count"),
        F.coalesce("total", F.lit(0)).cast("long").alias("total"),
    )


def nap_report(pages: DataFrame) -> DataFrame:
    return compare(candidates(pages, target_business(pages)), pages.select("site"))


def describe(report: DataFrame) -> DataFrame:
    """report with explanation: a sentence for each verdict."""
    n, vs = F.size("evidence"), F.col("normalized_values")
    q = lambda c: F.concat(F.lit("'"), c, F.lit("'"))
    a, b = F.get(vs, F.lit(0)), F.get(vs, F.lit(1))
    legal = (F.col("field") == "name") & (F.size(vs) == 2) & C.differs_only_by_legal_suffix(a, b)
    return report.withColumn(
        "explanation",
        F.when(F.col("verdict") == "insufficient_data", F.concat(F.lit("No "), "field", F.lit(" value found on any crawled page.")))
        .when(F.col("verdict") == "consistent", F.concat(F.lit("All "), n.cast("string"), F.lit(" "), "field", F.lit(" value(s) normalize to "), q(a), F.lit(".")))
        .when(legal, F.concat(F.lit("The names "), q(a), F.lit(" and "), q(b), F.lit(" differ only by legal suffix; they may be two companies, so neither is taken for the other.")))
        .otherwise(F.concat(F.size(vs).cast("string"), F.lit(" distinct "), "field", F.lit(" values were found across "), F.size("pages_compared").cast("string"), F.lit(" page(s): "), F.array_join(F.transform(F.slice(vs, 1, 4), q), ", "))),
    )


def fallback_pages(pages: DataFrame, limit: int = 3) -> DataFrame:
    """The few pages of a site worth a closer look: root pages, then contact-like ones, else the first."""
    like = F.exists(F.split(F.btrim(F.lower(U.path_of(F.col("final_url"))), F.lit("/")), "/"), lambda s: s.isin(CONTACT_LIKE))
    kind = F.when(U.is_root_path(F.col("final_url")), 0).when(like, 1).otherwise(2)
    w = Window.partitionBy("site").orderBy("kind", "pos")
    ranked = pages.withColumn("kind", kind).withColumn("k", F.row_number().over(w))
    return ranked.where(((F.col("kind") < 2) & (F.col("k") <= limit)) | (F.col("k") == 1)).drop("kind", "k")


def to_report_entries(report: DataFrame) -> DataFrame:
    """The delivered shape."""
    return report.select("field", "pages_compared", "values", "normalized_values", "confidence", "verdict")
