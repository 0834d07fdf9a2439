"""Writers: offers, per-page outputs and batch summaries as distributed files."""

from pyspark.sql import DataFrame

from offerlode.functions import values as V
from offerlode.operators.batch import observed, summary_text
from offerlode.sinks.packed import content_documents, report_documents, write_packed
from offerlode.sinks.render import csv_report, json_report, records, text_report

EXTENSIONS = {"text": "txt", "json": "json", "csv": "csv"}


def output_format(name: str) -> str:
    wanted = name.lower()
    if wanted not in EXTENSIONS:
        known = ", ".join(sorted(EXTENSIONS))
        raise ValueError(f"Unknown output format '{name}'. Available: {known}")
    return wanted


def _csv(df: DataFrame, path: str, mode: str) -> None:
    (df.write.mode(mode).option("header", True).option("escape", '"')
     .option("emptyValue", "").option("nullValue", "").csv(path))


def report_fragments(summaries: DataFrame, candidates: DataFrame, fmt: str) -> DataFrame:
    """(page_id, seq, text) of page reports in one of the three formats."""
    made = {"text": text_report, "json": json_report, "csv": csv_report}
    return made[output_format(fmt)](summaries, candidates)


def write_reports(summaries: DataFrame, candidates: DataFrame, fmt: str, path: str,
                  mode: str = "overwrite", keys: DataFrame | None = None) -> None:
    """Page reports as files in page order, or packed by output stem.

    ``keys`` (page_id, output_stem) packs one document per page (see ``sinks.packed``).
    Otherwise a range layout on (page, seq) keeps a document in order across file parts.
    """
    chosen = output_format(fmt)
    if keys is not None:
        write_packed(report_documents(report_fragments(summaries, candidates, chosen), keys), path, mode)
    elif chosen == "csv":
        _csv(records(candidates).select(*V.CSV_FIELDS), path, mode)
    else:
        report_fragments(summaries, candidates, chosen).repartitionByRange(
            "page_id", "seq").sortWithinPartitions("page_id", "seq").select("text").write.mode(
            mode).text(path)


def write_page_outputs(contents: DataFrame, keys: DataFrame, folder: str,
                       reports: DataFrame | None = None, mode: str = "overwrite") -> None:
    """Cleaned HTML, text and, where given, report fragments of pages, in one packed write."""
    documents = content_documents(contents, keys)
    if reports is not None:
        documents = documents.unionByName(report_documents(reports, keys))
    write_packed(documents, folder, mode)


def write_batch_summary(summary: DataFrame, path: str, mode: str = "overwrite") -> dict:
    """The 17-column summary as CSV; returns the batch totals, counted while it is written."""
    counted, totals = observed(summary)
    _csv(summary_text(counted), path, mode)
    return totals.get
