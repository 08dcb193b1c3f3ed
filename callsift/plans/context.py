"""From question to context: child chunks are searched, their parents are handed on."""

from __future__ import annotations

from pyspark.sql import DataFrame

from callsift.operators import retrieval as rt
from callsift.operators import textindex
from callsift.plans.sizing import lookup_side
from callsift.session import settle

CHUNK_KEY = [rt.KEY, "parent_no", "child_no"]


def chunk_hits(docs: DataFrame, queries: DataFrame, k: int = rt.TOP_K) -> DataFrame:
    """The k best child chunks of (contact_id, text) documents per (query_id, text) query."""
    _, children = rt.parent_child_chunks(docs)
    return rt.tfidf_search(children, queries, CHUNK_KEY, k)


def vector_hits(docs: DataFrame, queries: DataFrame, embed, k: int = rt.TOP_K) -> DataFrame:
    """The k nearest child chunks per query by the vectors of `embed`, a function of a list of texts."""
    _, children = rt.parent_child_chunks(docs)
    return rt.document_topk(queries, children, embed, CHUNK_KEY, k)


def index_chunks(docs: DataFrame, path: str) -> int:
    """Add the child chunks of (contact_id, text) documents to the index at `path`, see `textindex`."""
    _, children = rt.parent_child_chunks(docs)
    return textindex.append(children, path, CHUNK_KEY)


def contexts(docs: DataFrame, queries: DataFrame, k: int = rt.TOP_K, n: int = rt.CONTEXT_PARENTS,
             embed=None, index: str | None = None) -> DataFrame:
    """Context text and source calls per query; hits by words, or by vectors where `embed` is given. With
    an `index` of the documents' chunks, words are looked up there instead of in all texts.

    The few hits are written out between the steps, and only documents with a hit are cut again.
    """
    if index is not None:
        found = textindex.search(queries, index, CHUNK_KEY, k)
    else:
        found = chunk_hits(docs, queries, k) if embed is None else vector_hits(docs, queries, embed, k)
    hits = settle(found, "hits")
    wanted = lookup_side(hits.select(rt.KEY).distinct())
    parents, _ = rt.parent_child_chunks(docs.join(wanted, rt.KEY, "left_semi"))
    return rt.parents_of_hits(hits, parents, n)
