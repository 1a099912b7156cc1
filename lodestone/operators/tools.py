"""The tool registry: calls of tools as rows, their arguments checked, their handlers table functions under a lateral join."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.markdown import document_blocks
from .quality import violations

_ADDRESSES = "addresses array<struct<paragraph_id:string,heading_path:array<string>>>"


@F.udtf(returnType="address_no int, paragraph_id string, heading_path array<string>, content string")
class ReadBlocks:
    """The blocks of a document that addresses name, each found at most once: by paragraph id, or by heading path, where a
    chapter gives its own paragraphs and not its sub-chapters'. An address that finds nothing gives no row."""

    def eval(self, blocks, addresses):
        for no, address in enumerate(addresses or []):
            wanted, path = address["paragraph_id"], address["heading_path"]
            if wanted:
                for b in blocks or []:
                    if f"ch{b['chapter']}.p{b['number']}" == wanted:
                        yield no, wanted, None, b["text"]
                        break
            elif path:
                chapter = next((b["chapter"] for b in blocks or [] if b["heading"] == path[0]), None)
                sub = path[1] if len(path) > 1 else ""
                texts = [b["text"] for b in blocks or [] if b["chapter"] == chapter and b["sub"] == sub]
                if chapter is not None and texts:
                    yield no, None, path, "\n\n".join(texts)


@dataclass(frozen=True)
class Tool:
    """id, what it does, argument fields as DDL and as the JSON schema that a model is shown, its table function."""

    id: str
    description: str
    arguments: str
    schema: dict
    handler: type
    requires_document: bool | None = True
    modes: tuple[str, ...] = field(default=("chat", "nachdenken"))


READ_BLOCKS = Tool(
    "read_blocks", "Reads whole paragraphs or sections of the linked document", _ADDRESSES,
    {"type": "object", "required": ["addresses"], "properties": {"addresses": {"type": "array", "items": {"type": "object", "properties": {
        "paragraph_id": {"type": "string"}, "heading_path": {"type": "array", "items": {"type": "string"}}}}}}}, ReadBlocks)
TOOLS = {t.id: t for t in (READ_BLOCKS,)}


def available(mode: str, linked_document: bool) -> list[Tool]:
    return [t for t in TOOLS.values() if (t.requires_document is None or t.requires_document == linked_document) and (not t.modes or mode in t.modes)]


def schemas(tools: list[Tool]) -> list[dict]:
    """What a model is told about the tools."""
    return [{"type": "function", "function": {"name": t.id, "description": t.description, "parameters": t.schema}} for t in tools]


def argument_errors() -> Column:
    """Of calls with `tool` and `args` (JSON): unknown tools, arguments that are no JSON object, required ones that are missing."""
    known = F.col("tool").isin(list(TOOLS))
    parsed = F.from_json("args", "map<string,string>")
    missing = [(known & (F.col("tool") == t.id) & parsed.isNotNull() & ~F.coalesce(F.map_contains_key(parsed, F.lit(name)), F.lit(False)), f"{name} is missing") for t in TOOLS.values() for name in t.schema.get("required", [])]
    return violations((~F.coalesce(known, F.lit(False)), "tool is unknown"), (parsed.isNull(), "args are no object"), *missing)


def invoke(calls: DataFrame, docs: DataFrame, tool: Tool = READ_BLOCKS, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(results, refused). calls: call_id, key, tool, args; docs: key, text. Documents are parsed once, by column expressions;
    the handler gets the blocks of its call's document. Calls with errors are refused, each with the list of them."""
    judged = calls.withColumn("errors", argument_errors())
    good = judged.where((F.size("errors") == 0) & (F.col("tool") == tool.id)).select("call_id", key, F.from_json("args", tool.arguments).alias("args"))
    trees = docs.select(key, document_blocks(F.col("text")).alias("blocks"))
    results = good.join(trees, key).lateralJoin(tool.handler(F.col("blocks").outer(), F.col("args.addresses").outer())).drop("args", "blocks")
    return results, judged.where(F.size("errors") > 0).select("call_id", key, "errors")
