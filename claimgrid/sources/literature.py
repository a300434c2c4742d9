"""Saved records of literature databases: article metadata, texts, mappings of ids.

Records are XML documents as the public services return them, one or many a file; ``articles`` reads each article once with a declared schema, so columns that
nobody asks for are not parsed. ``full_texts`` and ``paragraphs`` take whole-article XML. Fetching is left to whoever has a network: all functions work on what
was saved. A column is null, or an empty list, where a record lacks the part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TEXT = "struct<_VALUE:string,_Label:string,_NlmCategory:string>"
_DATE = "struct<Year:string,Month:string,Day:string,MedlineDate:string>"
_ID = "struct<_VALUE:string,_IdType:string>"
ARTICLE = f"""MedlineCitation struct<
 PMID:struct<_VALUE:string>,
 Article:struct<
  Journal:struct<ISSN:struct<_VALUE:string,_IssnType:string>,JournalIssue:struct<Volume:string,Issue:string,PubDate:{_DATE}>,Title:string,ISOAbbreviation:string>,
  ArticleTitle:struct<_VALUE:string>,Pagination:struct<MedlinePgn:string>,
  Abstract:struct<AbstractText:array<{_TEXT}>>,
  AuthorList:struct<Author:array<struct<LastName:string,ForeName:string,Initials:string,CollectiveName:string>>>,
  PublicationTypeList:struct<PublicationType:array<struct<_VALUE:string,_UI:string>>>,
  DataBankList:struct<DataBank:array<struct<DataBankName:string,AccessionNumberList:struct<AccessionNumber:array<string>>>>>,
  ArticleDate:array<{_DATE}>>,
 MedlineJournalInfo:struct<NlmUniqueID:string,MedlineTA:string,ISSNLinking:string,Country:string>,
 ChemicalList:struct<Chemical:array<struct<RegistryNumber:string,NameOfSubstance:struct<_VALUE:string,_UI:string>>>>,
 MeshHeadingList:struct<MeshHeading:array<struct<DescriptorName:struct<_VALUE:string,_UI:string,_MajorTopicYN:string>,QualifierName:array<struct<_VALUE:string,_UI:string,_MajorTopicYN:string>>>>>,
 SupplMeshList:struct<SupplMeshName:array<struct<_VALUE:string,_UI:string,_Type:string>>>,
 CommentsCorrectionsList:struct<CommentsCorrections:array<struct<_RefType:string,PMID:struct<_VALUE:string>>>>>,
PubmedData struct<ArticleIdList:struct<ArticleId:array<{_ID}>>,History:struct<PubMedPubDate:array<struct<_PubStatus:string,Year:string,Month:string,Day:string>>>,
 ReferenceList:array<struct<Reference:array<struct<Citation:string,ArticleIdList:struct<ArticleId:array<{_ID}>>>>>>>"""

ABBREVIATED_MONTHS = {m: i + 1 for i, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split())}


def records(spark: SparkSession, path: str, row_tag: str = "PubmedArticle") -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).option("valueTag", "_VALUE").option("attributePrefix", "_").schema(" ".join(ARTICLE.split())).load(path)


def _all(c: Column, pick) -> Column:
    return F.coalesce(F.transform(c, pick), F.array().cast("array<string>"))


def _tidy(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def expand_pagination(pages: Column) -> Column:
    """``456-7`` to ``456-457``; other forms stay."""
    a, b = F.regexp_extract(pages, r"^(\d+)-(\d+)$", 1), F.regexp_extract(pages, r"^(\d+)-(\d+)$", 2)
    return F.when((a != "") & (F.length(b) < F.length(a)), F.concat(a, F.lit("-"), F.substr(a, F.lit(1), F.length(a) - F.length(b)), b)).otherwise(pages)


def date_of(d: Column) -> Column:
    """(year, month, day) as numbers; months by name or number, null where a part is missing. A free date gives its year."""
    months = F.create_map(*(F.lit(x) for p in ABBREVIATED_MONTHS.items() for x in p))
    year = F.coalesce(d["Year"].try_cast("int"), F.nullif(F.regexp_extract(d["MedlineDate"], r"(\d{4})", 1), F.lit("")).try_cast("int"))
    return F.struct(year.alias("year"), F.coalesce(d["Month"].try_cast("int"), F.try_element_at(months, F.substring(d["Month"], 1, 3))).alias("month"), d["Day"].try_cast("int").alias("day"))


def articles(rows: DataFrame) -> DataFrame:
    """One row a record: ids, title, abstract, journal, dates, authors, subject headings, substances, publication types, trial numbers, references, and whether it is retracted."""
    m, a = F.col("MedlineCitation"), F.col("MedlineCitation.Article")
    ids = F.col("PubmedData.ArticleIdList.ArticleId")
    id_of = lambda kind: F.get(F.filter(ids, lambda i: i["_IdType"] == kind), 0)["_VALUE"]
    parts = a["Abstract"]["AbstractText"]
    abstract = F.array_join(F.transform(F.filter(parts, lambda p: p["_VALUE"].isNotNull()), lambda p: _tidy(p["_VALUE"])), " ")
    heading = lambda d, q: F.struct(d["_VALUE"].alias("text"), d["_UI"].alias("mesh"), (d["_MajorTopicYN"] == "Y").alias("major"), F.lit("main").alias("type"), F.transform(q, lambda x: F.struct(x["_VALUE"].alias("text"), x["_UI"].alias("mesh"))).alias("qualifiers"))
    main = F.transform(m["MeshHeadingList"]["MeshHeading"], lambda h: heading(h["DescriptorName"], h["QualifierName"]))
    extra = F.transform(m["SupplMeshList"]["SupplMeshName"], lambda s: F.struct(s["_VALUE"].alias("text"), s["_UI"].alias("mesh"), F.lit(False).alias("major"), F.lit("supplementary").alias("type"), F.lit(None).cast("array<struct<text:string,mesh:string>>").alias("qualifiers")))
    mesh_type = "array<struct<text:string,mesh:string,major:boolean,type:string,qualifiers:array<struct<text:string,mesh:string>>>>"
    none = F.array().cast(mesh_type)
    banks = F.filter(a["DataBankList"]["DataBank"], lambda b: b["DataBankName"] == "ClinicalTrials.gov")
    kinds = _all(a["PublicationTypeList"]["PublicationType"], lambda t: t["_VALUE"])
    refs = F.flatten(F.transform(F.col("PubmedData.ReferenceList"), lambda r: F.transform(r["Reference"], lambda x: F.struct(x["Citation"].alias("citation"), F.get(F.filter(x["ArticleIdList"]["ArticleId"], lambda i: i["_IdType"] == "pubmed"), 0)["_VALUE"].alias("pmid")))))
    author = lambda x: F.coalesce(x["CollectiveName"], F.concat_ws(" ", x["ForeName"], x["LastName"]))
    return rows.select(
        m["PMID"]["_VALUE"].alias("pmid"), id_of("doi").alias("doi"), id_of("pmc").alias("pmcid"), _tidy(a["ArticleTitle"]["_VALUE"]).alias("title"), F.when(abstract != "", abstract).alias("abstract"),
        F.concat_ws(" ", _tidy(a["ArticleTitle"]["_VALUE"]), F.when(abstract != "", abstract)).alias("title_abstract"),
        a["Journal"]["Title"].alias("journal_title"), a["Journal"]["ISOAbbreviation"].alias("journal_abbrev"), m["MedlineJournalInfo"]["NlmUniqueID"].alias("journal_nlm_id"), m["MedlineJournalInfo"]["Country"].alias("country"),
        F.struct(F.when(a["Journal"]["ISSN"]["_IssnType"] == "Print", a["Journal"]["ISSN"]["_VALUE"]).alias("print"), F.when(a["Journal"]["ISSN"]["_IssnType"] == "Electronic", a["Journal"]["ISSN"]["_VALUE"]).alias("electronic"), m["MedlineJournalInfo"]["ISSNLinking"].alias("linking")).alias("issn"),
        a["Journal"]["JournalIssue"]["Volume"].alias("volume"), a["Journal"]["JournalIssue"]["Issue"].alias("issue"), expand_pagination(a["Pagination"]["MedlinePgn"]).alias("page"), date_of(a["Journal"]["JournalIssue"]["PubDate"]).alias("published"),
        _all(a["AuthorList"]["Author"], author).alias("authors"), F.concat(F.coalesce(main.cast(mesh_type), none), F.coalesce(extra.cast(mesh_type), none)).alias("mesh_annotations"),
        F.transform(m["ChemicalList"]["Chemical"], lambda c: F.struct(c["NameOfSubstance"]["_UI"].alias("mesh"), c["NameOfSubstance"]["_VALUE"].alias("name"), c["RegistryNumber"].alias("registry"))).alias("substances"),
        kinds.alias("publication_types"), F.coalesce(F.flatten(F.transform(banks, lambda b: b["AccessionNumberList"]["AccessionNumber"])), F.array().cast("array<string>")).alias("nct_ids"), refs.alias("references"),
        (F.array_contains(kinds, "Retracted Publication") | F.coalesce(F.exists(m["CommentsCorrectionsList"]["CommentsCorrections"], lambda c: c["_RefType"] == "RetractionIn"), F.lit(False))).alias("retracted"),
    )


def retractions(found: DataFrame) -> DataFrame:
    """(pmid): retracted articles."""
    return found.where("retracted").select("pmid").distinct()


def pmids_for_mesh(found: DataFrame, mesh: DataFrame, major_only: bool = False, closed: DataFrame | None = None) -> DataFrame:
    """(mesh, pmid) of articles with the headings of ``mesh(mesh)``, or, with a closed hierarchy, with ones below them."""
    rows = found.select("pmid", F.explode("mesh_annotations").alias("h"))
    rows = (rows.where("h.major") if major_only else rows).select("pmid", F.col("h.mesh").alias("own"))
    wanted = mesh.select("mesh", F.col("mesh").alias("own"))
    if closed is not None:
        wanted = wanted.union(mesh.join(closed.where("ns = 'MESH' and p_ns = 'MESH'").select(F.col("p_id").alias("mesh"), F.col("id").alias("own")), "mesh").select("mesh", "own")).distinct()
    return rows.join(wanted, "own").select("mesh", "pmid").distinct()


def pmids_for_genes(links: DataFrame, genes: DataFrame) -> DataFrame:
    """(gene, pmid) by ``links(egid, pmid)`` and ``genes(gene, egid)``."""
    return links.join(genes, "egid").select("gene", "pmid").distinct()


def issns_for_journals(found: DataFrame) -> DataFrame:
    """(journal_nlm_id, issns): all numbers under which a journal appears, the linking one first."""
    each = found.select("journal_nlm_id", F.explode(F.array(F.struct(F.lit(0).alias("r"), F.col("issn.linking").alias("i")), F.struct(F.lit(1).alias("r"), F.col("issn.print").alias("i")), F.struct(F.lit(1).alias("r"), F.col("issn.electronic").alias("i")))).alias("x")).where("x.i is not null")
    one = each.groupBy("journal_nlm_id", F.col("x.i").alias("i")).agg(F.min("x.r").alias("r"))
    return one.groupBy("journal_nlm_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "i"))), lambda x: x["i"]).alias("issns"))


def id_lookup(ids: DataFrame, mapping: DataFrame, known: str) -> DataFrame:
    """``ids(id)`` of the kind ``known`` (pmid, pmcid or doi) with all three, by ``mapping(pmid, pmcid, doi)``."""
    one = mapping.where(F.col(known).isNotNull()).groupBy(F.col(known).alias("id")).agg(F.max(F.struct("pmid", "pmcid", "doi")).alias("x")).select("id", "x.*")
    return ids.join(one, "id", "left")


def filter_pmids(pmids: DataFrame, held: DataFrame, source_type: str) -> DataFrame:
    """Articles that a collection of texts holds: ``held(pmid, source_type)``."""
    return pmids.join(held.where(F.col("source_type") == source_type).select("pmid").distinct(), "pmid", "left_semi")


def has_full_text(pmids: DataFrame, held: DataFrame) -> DataFrame:
    return pmids.join(held.select("pmid", F.lit(True).alias("has_full_text")).distinct(), "pmid", "left").withColumn("has_full_text", F.coalesce("has_full_text", F.lit(False)))


# texts

_TAGS = r"<[^>]+>"
_SKIPPED = r"(?s)<(table-wrap|fig|xref|tex-math|mml:math|inline-formula|ref-list|ack|fn-group|ce:cross-refs?|ce:cross-ref)\b[^>]*>.*?</\1>"
_PARAGRAPHS = r"(?s)<((?:ce:|jats:)?(?:p|para|simple-para|title|section-title|article-title))\b[^>]*>(.*?)</\1>"


def plain(xml: Column) -> Column:
    """Text of a piece of XML: without tags, common character references decoded, white space single."""
    text = F.regexp_replace(xml, _TAGS, "")
    for mark, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#x2009;|&#160;|&nbsp;", " "), ("&amp;", "&")):
        text = F.regexp_replace(text, mark, sign)
    return _tidy(text)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, xml): a row a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("xml"))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(path, paragraphs): titles and paragraphs in order, without tables, figures, formulas and references; one that holds another's text is taken as it is."""
    bare = F.regexp_replace("xml", _SKIPPED, " ")
    found = F.regexp_extract_all(bare, F.lit(_PARAGRAPHS), F.lit(2))
    return docs.select(*(c for c in docs.columns if c != "xml"), F.filter(F.transform(found, plain), lambda p: p != "").alias("paragraphs"))


def full_texts(docs: DataFrame) -> DataFrame:
    """(path, text): paragraphs, each on a line; null where there is none. A text that is no XML stays as it is."""
    text = F.array_join("paragraphs", "\n")
    rows = paragraphs(docs.withColumn("__plain", F.when(~F.col("xml").rlike(r"^\s*<"), F.col("xml"))))
    return rows.withColumn("text", F.coalesce("__plain", F.when(text != "", text))).drop("__plain", "paragraphs")


def filter_paragraphs(rows: DataFrame, words: list[str] | None) -> DataFrame:
    """Only paragraphs with one of the words (as whole words); none given keeps all. Left ones are joined by line ends as ``text``."""
    import re

    kept = F.col("paragraphs")
    if words is not None:
        pattern = r"(?<![^\W])(?:" + "|".join(re.escape(w) for w in words) + r")(?![^\W])"
        kept = F.filter("paragraphs", lambda p: p.rlike(pattern))
    return rows.withColumn("text", F.array_join(kept, "\n"))


def preprint_text(docs: DataFrame, format_: str = "xml") -> DataFrame:
    """Texts of preprint servers, saved as XML or plain text."""
    return full_texts(docs) if format_ == "xml" else docs.select("path", F.col("xml").alias("text"))


def crossref_links(works: DataFrame) -> DataFrame:
    """``works(message)``, the saved JSON of a registry's work, to (doi, publisher, url, license, links)."""
    schema = "message struct<DOI:string,publisher:string,URL:string,license:array<struct<URL:string>>,link:array<struct<URL:string,`content-type`:string>>>"
    m = works.select(F.from_json("value", schema).alias("w")).select("w.message.*")
    return m.select(F.col("DOI").alias("doi"), "publisher", F.col("URL").alias("url"), F.transform("license", lambda x: x["URL"]).alias("license"), F.transform("link", lambda x: x["URL"]).alias("links"))


def trials_of_text(docs: DataFrame) -> DataFrame:
    """(path, nct_id): trial numbers anywhere in a full text."""
    return docs.select("path", F.explode(F.array_distinct(F.regexp_extract_all("xml", F.lit(r"NCT\d{8}"), F.lit(0)))).alias("nct_id"))
