"""Writers of documents and messages."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_documents(documents: DataFrame, path: str, text: str = "document") -> None:
    """One text file row a document, in as many files as there are partitions."""
    documents.select(text).write.mode("overwrite").text(path, lineSep="\n\f\n")


def write_messages(messages: DataFrame, path: str) -> None:
    messages.write.mode("append").json(path)
