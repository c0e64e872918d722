"""Answering with tools: a bounded loop around a pluggable chat model, told as events."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import Settings
from .functions.embedding import Embedder, embed_text
from .functions.text import rewrite_question
from .operators.lifecycle import require_ready
from .operators.messages import frame
from .operators.search import NOTHING_FOUND, SEPARATOR, fetch, fts_topk_ranked, vector_topk

@dataclass
class ToolSpec:
    name: str
    description: str
    parameters: dict[str, str]


SEARCH = ToolSpec("search_document", "Passages of the document that bear on the query; call again with other words if they don't suffice.", {"query": "string"})


def system_prompt(settings: Settings) -> str:
    """What a model is told of its one tool and of the bounds of the loop."""
    return (
        f"One document is open. {SEARCH.name}({', '.join(SEARCH.parameters)}) returns up to {settings.top_k} of its passages, or says that none was found. "
        f"Calls are answered for {settings.agent_rounds} rounds; short names and labels match better than whole sentences. "
        "Every statement of the answer must rest on returned passages; where they don't hold the answer, say so."
    )


@dataclass
class ToolCall:
    id: str
    args: dict[str, str]
    name: str = SEARCH.name


@dataclass
class Reply:
    content: str = ""
    tool_calls: list[ToolCall] = field(default_factory=list)


@dataclass
class Message:
    role: str
    content: str
    tool_calls: list[ToolCall] = field(default_factory=list)
    tool_call_id: str | None = None


class ChatModel(Protocol):
    """``reply`` may ask for tools; ``stream`` gives the answer's tokens."""

    def reply(self, messages: list[Message], tools: list[ToolSpec]) -> Reply: ...

    def stream(self, messages: list[Message]) -> Iterator[str]: ...


class ScriptedModel:
    """Replies and tokens given beforehand, for tests."""

    def __init__(self, replies: list[Reply], tokens: list[str]):
        self.replies, self.tokens, self.seen = list(replies), tokens, []

    def reply(self, messages: list[Message], tools: list[ToolSpec]) -> Reply:
        self.seen.append(list(messages))
        return self.replies.pop(0) if self.replies else Reply()

    def stream(self, messages: list[Message]) -> Iterator[str]:
        self.seen.append(list(messages))
        yield from self.tokens


def rewritten(chunks: DataFrame, question: str) -> str:
    return chunks.sparkSession.range(1).select(rewrite_question(F.lit(question)).alias("q")).first()["q"]


def search_tool(chunks: DataFrame, document_id, embedder: Embedder, k: int = 8) -> Callable[[str], tuple[str, list[dict]]]:
    """A search of one document: the context text and the hits, in order: vector hits, then text hits that these lack, ``k`` in all."""
    spark, own = chunks.sparkSession, chunks.filter(F.col("document_id") == document_id)

    def search(query: str) -> tuple[str, list[dict]]:
        core = rewritten(chunks, query)
        hits = [r.asDict() for r in vector_topk(own, embed_text(embedder, core), document_id, k).select("chunk_index", "content").collect()]
        if len(hits) < k:
            keys = ["document_id", "chunk_index"]
            ids = fts_topk_ranked(own, spark.createDataFrame([(0, core)], "query_id int, query string"), k).select(*keys, "rank")
            found = fetch(own, ids, keys).join(ids, keys).orderBy("rank").select("chunk_index", "content").collect()
            seen = {h["chunk_index"] for h in hits}
            hits += [r.asDict() for r in found if r["chunk_index"] not in seen][: k - len(hits)]
        return SEPARATOR.join(h["content"] for h in hits) or NOTHING_FOUND, hits

    return search


def answer(question: str, model: ChatModel, search: Callable[[str], tuple[str, list[dict]]], settings: Settings | None = None) -> Iterator[dict]:
    """Events: tokens, one citations event, done.

    Up to ``agent_rounds`` replies may call tools, any number each; the reply that calls none is put
    aside, and the answer is streamed from the conversation as it then stands.
    """
    settings = settings or Settings()
    talk, hits = [Message("system", system_prompt(settings)), Message("human", question)], []
    for _ in range(settings.agent_rounds):
        reply = model.reply(talk, [SEARCH])
        if not reply.tool_calls:
            break
        talk.append(Message("ai", reply.content, reply.tool_calls))
        for call in reply.tool_calls:
            text, found = search(call.args["query"])
            hits += found
            talk.append(Message("tool", text, tool_call_id=call.id))
    yield from ({"type": "token", "content": token} for token in model.stream(talk) if token)
    first: dict[int, str] = {}
    for hit in hits:
        first.setdefault(hit["chunk_index"], hit["content"][: settings.citation_chars])
    yield {"type": "citations", "chunks": [{"chunk_index": k, "content": v} for k, v in first.items()]}
    yield {"type": "done"}


def chat(documents: DataFrame, chunks: DataFrame, document_id: str, question: str, model: ChatModel, embedder: Embedder, settings: Settings | None = None) -> Iterator[str]:
    """Frames of a whole answer; an unknown or unready document is an error before the first frame, a later one an error event without an end."""
    require_ready(documents, document_id)

    def frames() -> Iterator[str]:
        try:
            for event in answer(question, model, search_tool(chunks, document_id, embedder, (settings or Settings()).top_k), settings):
                yield frame(event)
        except Exception as error:  # told to the client as an event
            yield frame({"type": "error", "message": str(error)})

    return frames()
