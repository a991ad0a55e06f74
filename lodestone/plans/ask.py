"""From a table of questions to cited answers, and from documents to a searchable collection."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from lodestone.operators import answers, chunk, citations, evidence, router, vectors
from lodestone.session import materialize


@dataclass
class Asked:
    questions: DataFrame
    evidence: DataFrame
    answers: DataFrame
    citations: DataFrame
    errors: dict[str, str]
    # Milliseconds by stage, with the names that the reports in ``metrics`` read.
    timings: dict[str, float]

    def runs(self, run_id: str, llm_status: str = "extractive") -> DataFrame:
        """One nested record per question. Timings are those of the whole batch of questions."""
        rows = self.evidence.groupBy("question_id").agg(
            F.collect_list(F.struct(*[c for c in self.evidence.columns if c != "question_id"])).alias("evidence")
        )
        cited = self.citations.select("question_id", F.struct(*self.citations.columns[1:]).alias("citations"))
        problems = F.lit("; ".join(f"{s}: {e}" for s, e in self.errors.items()))
        return (
            self.answers.select("question_id", "question", "route", "sources", "reasons", "answer", "prompt")
            .join(rows, "question_id", "left")
            .join(cited, "question_id", "left")
            .select(
                F.lit(run_id).alias("run_id"), "*", problems.alias("errors"), F.lit(llm_status).alias("llm_status"),
                *[F.lit(ms).alias(stage) for stage, ms in self.timings.items()],
            )
        )


def ask(
    questions: DataFrame, tables: dict[str, DataFrame], as_of: Column, embedder: vectors.Embedder | None = None,
    reason: str = "no model configured",
) -> Asked:
    """Route, gather evidence, build prompts and answer from the evidence alone.

    Every stage is written once to the shared folder and timed; texts that many questions share are kept apart from the evidence
    and put into it where it is read. A source that fails is reported, and the others go on.
    """
    timings, began = {}, time.perf_counter()

    def timed(stage: str, since: float) -> float:
        now = time.perf_counter()
        timings[stage] = 1000 * (now - since)
        return now

    routed = materialize(router.route(questions), "routed")
    at = timed("routing_ms", began)
    found, errors, by_source = evidence.collect(routed, tables, as_of, embedder)
    timings.update(by_source)
    at = timed("retrieval_ms", at)
    prompted = materialize(answers.build_prompt(routed, found), "prompts")
    at = timed("prompt_ms", at)
    answered = materialize(answers.extractive(prompted, found, reason), "answers")
    timed("generation_ms", at)
    timed("total_ms", began)
    return Asked(routed, found, answered, citations.check(answered, found), errors, timings)


def index_documents(
    pages: DataFrame, embedder: vectors.Embedder | None = None, indexed_at: str | None = None, batch: int = 64
) -> DataFrame:
    """Page records to sentence chunks with vectors."""
    return vectors.embed(chunk.sentences(pages, indexed_at=indexed_at), embedder or vectors.HashedTerms(), batch=batch)
