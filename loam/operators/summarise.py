"""Summaries by a pluggable text provider.

A provider is a function of (system, user, max_tokens, temperature) that returns a text. The default is deterministic and
local: it extracts the first lines. Providers run in Arrow batches on the executors, with retries as remote ones need.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.functions import scalar
from loam.operators.tags import content_tags
from loam.sources.ship import ship

Provider = Callable[[str, str, int, float], str]
REGISTRY: dict[str, Provider] = {}


def provider(name: str) -> Callable[[Provider], Provider]:
    """Registers a provider under a name."""

    def add(f: Provider) -> Provider:
        REGISTRY[name] = f
        return f

    return add


@provider("extract")
def extract(system: str, user: str, max_tokens: int, temperature: float) -> str:
    """The first five lines of the last part of the prompt."""
    body = user.rpartition("\n\n")[2]
    return "\n".join(x for x in body.split("\n") if x.strip())[: 4 * max_tokens].strip() if body else ""


class LimitError(Exception):
    """Too many requests; wait and try again."""


def complete(call: Provider, system: str, user: str, max_tokens: int, temperature: float, attempts: int = 3, sleep: Callable[[float], None] = time.sleep, shrink: float | None = None, fallback: Provider | None = None) -> str:
    """A provider's answer, with up to three attempts; errors about the size of the request are not tried again.

    With shrink, a request that is too large is tried again with this share of its text; with fallback, another provider is asked at last.
    """
    for k in range(attempts):
        try:
            return call(system, user, max_tokens, temperature)
        except Exception as e:
            large = any(w in str(e).lower() for w in ("context", "maximum", "tokens"))
            if large and shrink and k < attempts - 1:
                user = user[: int(len(user) * shrink)]
                continue
            if k == attempts - 1 or large:
                if fallback is None:
                    raise
                return complete(fallback, system, user, max_tokens, temperature, attempts, sleep, shrink)
            sleep(min(2.0**k, 30.0) if isinstance(e, LimitError) else 1.0 * (k + 1))
    raise AssertionError


def validate(name: str | Provider) -> tuple[bool, str | None]:
    """Whether a provider answers a short request at all, and the error if not."""
    try:
        call = REGISTRY[name] if isinstance(name, str) else name
        return bool(call("You are a test.", "Reply with: OK", 20, 0.0)), None
    except KeyError:
        return False, f"no provider {name!r}"
    except Exception as e:
        return False, str(e)


def module_prompt(files: DataFrame, max_tokens: int = 2000) -> DataFrame:
    """(path, prompt): path, language, exported names, dependencies' summaries and the source, cut to what leaves room for the answer.

    files: (path, language, content, exports, dependencies).
    """
    source = scalar.truncate_to_tokens(F.col("content"), max(1, max_tokens - 600))
    parts = F.array(F.concat(F.lit("File: "), "path"), F.concat(F.lit("Language: "), "language"), F.concat(F.lit("Exports: "), F.coalesce("exports", F.lit("none"))), F.concat(F.lit("Depends on:\n"), F.coalesce("dependencies", F.lit("none"))), source)
    return files.select("path", F.array_join(parts, "\n\n").alias("prompt"))


def run(prompts: DataFrame, name: str | Provider = "extract", system: str = "Summarise this module.", max_tokens: int = 2000, temperature: float = 0.2) -> DataFrame:
    """(path, content): a provider's answer to each prompt; a call that fails for good gives null."""
    call = REGISTRY[name] if isinstance(name, str) else name
    ship(prompts.sparkSession)

    def batches(it):
        for b in it:
            out = []
            for p in b.column("prompt").to_pylist():
                try:
                    out.append(complete(call, system, p, max_tokens, temperature))
                except Exception:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(out, pa.string())], names=["path", "content"])

    return prompts.select("path", "prompt").mapInArrow(batches, "path string, content string")


def artifacts(summaries: DataFrame, kind: str, as_of: str, by: str = "extract") -> DataFrame:
    """Artifact rows of (path, content): id, tokens and tags of each. summaries is read twice, so it should be a stored table."""
    c = F.col("content")
    kept = summaries.where("content is not null")
    tags = content_tags(kept.select(F.col("path").alias("id"), "path", "content")).select(F.col("id").alias("path"), "tags")
    return kept.join(tags, "path").select(
        F.sha2(c, 256).alias("id"), F.lit(kind).alias("type"), "path", "content",
        F.struct(F.lit(as_of).cast("timestamp_ntz").alias("generated_at"), F.lit(by).alias("generated_by"), F.sha2("path", 256).alias("source_hash"), scalar.token_count(c).alias("token_count"), F.lit(1).alias("version"), F.lit(0.85).alias("confidence")).alias("metadata"),
        "tags",
    )
