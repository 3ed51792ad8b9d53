"""Models as column expressions: embedding and text generation.

The engine only sees columns, so a model may be a pandas UDF that calls a
service, or plain Spark functions.  The offline models need no network and give
the same output for the same input.
"""

from __future__ import annotations

import re
import time
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# text -> array<float>
Embedder = Callable[[Column], Column]
# prompt -> struct of REPLY
Generator = Callable[[Column], Column]

REPLY = (
    "reply string, prompt_tokens long, completion_tokens long, total_tokens long, "
    "reasoning_tokens long, seconds double, error string"
)


def hashing_embedder(dim: int = 256, batch_size: int = 32) -> Embedder:
    """Bag of words hashed into ``dim`` signed buckets, scaled to unit length."""

    def embed_batch(texts: pd.Series) -> list[np.ndarray]:
        rows = []
        for text in texts:
            row = np.zeros(dim, np.float32)
            for word in re.findall(r"\w+", (text or "").lower()):
                code = zlib.crc32(word.encode("utf-8"))
                row[code % dim] += 1.0 if code & 0x80000000 else -1.0
            norm = float(np.linalg.norm(row))
            rows.append(row / norm if norm else row)
        return rows

    return batched_embedder(embed_batch, batch_size)


def batched_embedder(embed_batch: Callable[[pd.Series], list], batch_size: int) -> Embedder:
    """An embedder that hands ``batch_size`` texts at a time to ``embed_batch``."""

    def column(text: Column) -> Column:
        @F.pandas_udf("array<float>")
        def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                rows: list = []
                for start in range(0, len(texts), batch_size):
                    rows.extend(embed_batch(texts.iloc[start : start + batch_size]))
                yield pd.Series(rows, dtype=object)

        return embed(text)

    return column


def sentence_transformer_embedder(model: str, batch_size: int = 32) -> Embedder:
    """Embeddings of a local sentence-transformers model, loaded once per Python worker."""
    model_id = model.removeprefix("huggingface/")

    def column(text: Column) -> Column:
        @F.pandas_udf("array<float>")
        def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            from sentence_transformers import SentenceTransformer

            encoder = SentenceTransformer(model_id, device="cpu")
            for texts in batches:
                vectors = encoder.encode(texts.tolist(), batch_size=batch_size, show_progress_bar=False)
                yield pd.Series(list(vectors), dtype=object)

        return embed(text)

    return column


def chat_generator(
    model: str, temperature: float = 0.0, max_tokens: int = 2048, api_base: str | None = None,
    system: str | None = None,
) -> Generator:
    """Replies of a chat model through litellm; a failed call becomes a row with ``error``."""

    def one(prompt: str) -> tuple:
        import litellm

        messages = [{"role": "system", "content": system}] if system else []
        messages.append({"role": "user", "content": prompt})
        options = {"api_base": api_base} if api_base else {}
        start = time.monotonic()
        try:
            answer = litellm.completion(
                model=model, messages=messages, temperature=temperature, max_tokens=max_tokens, **options
            )
        except Exception as e:  # noqa: BLE001
            return (None, 0, 0, 0, 0, time.monotonic() - start, str(e))
        usage = getattr(answer, "usage", None)
        details = getattr(usage, "completion_tokens_details", None)
        count = lambda source, name: int(getattr(source, name, 0) or 0)
        return (
            answer.choices[0].message.content,
            count(usage, "prompt_tokens"), count(usage, "completion_tokens"), count(usage, "total_tokens"),
            count(details, "reasoning_tokens"), time.monotonic() - start, None,
        )

    names = [part.split()[0] for part in REPLY.split(", ")]

    def column(prompt: Column) -> Column:
        @F.pandas_udf(REPLY)
        def generate(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for prompts in batches:
                yield pd.DataFrame([one(p) for p in prompts], columns=names)

        return generate(prompt)

    return column


def _offline_reply(prompt: Column, reply: Column) -> Column:
    """A reply with word counts in place of model tokens and no latency."""
    count = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: w != "")).cast("long")
    return F.struct(
        reply.alias("reply"),
        count(prompt).alias("prompt_tokens"),
        count(reply).alias("completion_tokens"),
        (count(prompt) + count(reply)).alias("total_tokens"),
        F.lit(0).cast("long").alias("reasoning_tokens"),
        F.lit(0.0).alias("seconds"),
        F.lit(None).cast("string").alias("error"),
    )


def offline_answer(prompt: Column) -> Column:
    """Answers with the first line of the context."""
    return _offline_reply(prompt, F.regexp_extract(prompt, r"^Context:\n([^\n]*)", 1))


# Verbs the offline extraction cuts a sentence at.
_VERBS = (
    "was born in|is located in|is displayed in|was painted by|is the capital of|is the capital city of|"
    "invented|discovered|developed|predicted|painted|is used in|is|was"
)


def offline_triples(text: Column) -> Column:
    """Reads the first ``subject verb object`` of the text, as a JSON array of at most one item."""
    pattern = rf"^(?s)\s*(.+?) ({_VERBS}) (.+?)\.?\s*$"
    subject, verb, obj = (F.regexp_extract(text, pattern, i) for i in (1, 2, 3))
    item = F.struct(
        subject.alias("subject"),
        F.replace(verb, F.lit(" "), F.lit("_")).alias("predicate"),
        F.concat_ws(" ", verb, obj).alias("description"),
        obj.alias("object"),
    )
    return _offline_reply(text, F.when(subject == "", F.lit("[]")).otherwise(F.to_json(F.array(item))))


def offline_choice(prompt: Column) -> Column:
    """Finds no match among the candidates."""
    return _offline_reply(prompt, F.lit("0"))


TRIPLE_PROMPT = """Read the text and list the relations it states.
Reply with a JSON array only. Every item has the keys "subject", "predicate" and "object",
all short strings; write predicates in lower case with underscores.

Text: """

DESCRIBED_TRIPLE_PROMPT = """Read the text and list every fact it states as a relation between two named things.
Reply with a JSON array only. Every item has the keys "subject", "predicate", "description" and "object";
the description is one clause that holds all details of the relation.

Text: """


def choice_prompt(name: Column, block: Column) -> Column:
    return F.concat(
        F.lit('Which of the numbered names means the same thing as "'), name, F.lit('"?\n'), block,
        F.lit("\nReply with its number only, or 0 if none does."),
    )


ANSWER_INSTRUCTION = (
    "Answer the question from the given context alone. Say so if the context does not hold the answer."
)


@dataclass(frozen=True)
class Models:
    """The models a variant uses, each replaceable on its own."""

    embed: Embedder
    triples: Generator = offline_triples
    described_triples: Generator = offline_triples
    choose: Generator = offline_choice
    answer: Generator = offline_answer


def offline_models(dim: int = 256, batch_size: int = 32) -> Models:
    return Models(embed=hashing_embedder(dim, batch_size))


def service_models(config) -> Models:
    """Models behind the services a configuration names."""
    llm, k = config.llm, config.vecgraph
    prefixed = lambda prefix, gen: lambda text: gen(F.concat(F.lit(prefix), text))
    return Models(
        embed=sentence_transformer_embedder(config.embedding.model, config.embedding.batch_size),
        triples=prefixed(TRIPLE_PROMPT, chat_generator(llm.model, 0.0, 512)),
        described_triples=prefixed(
            DESCRIBED_TRIPLE_PROMPT, chat_generator(llm.model, 0.0, k.extraction_max_tokens if k else 1024)
        ),
        choose=chat_generator(llm.model, 0.0, 4),
        answer=chat_generator(llm.model, llm.temperature, llm.max_tokens, llm.api_base, ANSWER_INSTRUCTION),
    )
