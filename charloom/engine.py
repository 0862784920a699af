"""The engine: one object with the steps from files to persona card, each a DataFrame in and out."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from charloom.config import Config
from charloom.functions.shared import save
from charloom.model import cocreate, prompts
from charloom.model.client import ModelClient, flatten, structured, with_retry
from charloom.operators import chunking, distill, dna, evaluate, index, mentions, profile, resolve
from charloom.sources import artifacts, corpus


def _card(reply) -> dict:
    """A full card out of a model's object, empty layers filled in."""
    base = {"schema_version": 1, "display_name": "", "error_reply": "", "tags": [], "traits_summary": "", "expression_dna": {}, "mental_models": [], "decision_heuristics": [], "anti_patterns": [], "honest_boundaries": []}
    card = artifacts.check_card(base | reply)
    card["expression_dna"] = {"vocabulary": [], "rhythm": "", "rhetorical_tics": [], "signature_metaphors": [], "opening_samples": []} | (card["expression_dna"] or {})
    check = {"cross_domain": False, "generative": False, "exclusive": False, "cross_domain_evidence": [], "generative_example": "", "exclusivity_note": ""}
    card["mental_models"] = [m | {"verification": check | (m.get("verification") or {})} for m in card["mental_models"]]
    return card


VERIFICATION = "struct<cross_domain:boolean,generative:boolean,exclusive:boolean,cross_domain_evidence:array<string>,generative_example:string,exclusivity_note:string>"
MODEL = f"name string, principle string, verification {VERIFICATION}"


def place(workdir: str) -> str:
    """Where tables go: workdir as it is if it names a store that the cluster shares, else a local folder."""
    return workdir.rstrip("/") if "://" in workdir else f"file://{Path(workdir).resolve()}"


class Engine:
    def __init__(self, spark: SparkSession, config: Config | None = None, ask: ModelClient | None = None, embed: Callable[[DataFrame], DataFrame] | None = None, score: Callable[[DataFrame], DataFrame] | None = None):
        """embed adds `embedding` to rows with `text`, score adds `score` to rows with `query` and `text`; see model.embed."""
        self.spark, self.config, self.ask, self.embed, self.score = spark, config or Config(), ask, embed, score
        folder = place(self.config.workdir)
        self.store = index.IndexStore(spark, f"{folder}/index", embed=embed)
        self._signals = f"{folder}/signals"

    # the tools

    def load(self, path: str) -> DataFrame:
        return corpus.load_corpus(self.spark, corpus.resolve_path(path, self.config.workdir), self.config.max_input_mb)

    def chunks(self, docs: DataFrame) -> DataFrame:
        c = self.config
        found = chunking.chunk(docs.select(F.col("relpath").alias("source"), "corpus_uuid", "content_hash", "text"), c.intake_chunk_tokens, c.intake_chunk_overlap, count=self._count())
        return chunking.dedup(found, ["corpus_uuid", "source"], self.embed, c.dedup_threshold)

    def mentions(self, chunks: DataFrame) -> DataFrame:
        """By the model; without one by the heuristic."""
        if self.ask is None:
            return mentions.heuristic_mentions(chunks).withColumnRenamed("char_start", "chunk_start").drop("char_end", "text")
        found = mentions.extract_mentions(chunks, lambda p, ask=self.ask: flatten(ask(p)), lambda t: prompts.NER.format(text=t))
        return found.withColumnRenamed("char_start", "mention_start").withColumnRenamed("char_end", "mention_end").drop("text")

    def index(self, found: DataFrame) -> int:
        """Adds mentions to the index; how many entries it grew by."""
        before = self.store.count()
        self.store.add(mentions.to_entries(found))
        return self.store.count() - before

    def index_batch(self, payload: str) -> int:
        before = self.store.count()
        self.store.add(mentions.ingest_batch(self.spark, payload))
        return self.store.count() - before

    def resolve(self) -> resolve.Resolution:
        """Merges names that are one. With an embedder the vectors of their evidence count as a signal of its own."""
        entries = self.store.entries()
        known = self.embed(entries) if self.embed else entries
        found = resolve.resolve(known, self.config.auto_merge, vector="embedding" if self.embed else None)
        if not found.merges.isEmpty():
            self.store.merge_all(resolve.merge_map(self.spark, found))
        return found

    def characters(self) -> DataFrame:
        return index.characters(self.store.entries())

    def search(self, query: str, name: str | None = None) -> DataFrame:
        """By vectors where there is an embedder, else by text; the same k either way."""
        if self.embed:
            asked = self.embed(self.spark.createDataFrame([(query,)], "text string")).first()
            return self.store.search_vector(list(asked.embedding), name, self.config.top_k)
        return self.store.search_text(query, name, self.config.top_k)

    def entries(self, name: str) -> DataFrame:
        known = index.resolve_name(name, self.characters())
        if known is None:
            raise KeyError(name)
        return index.of_character(self.store.entries(known), known)

    def save_signals(self, distillates: DataFrame) -> int:
        artifacts.write_distillates(distillates, self._signals)
        return self.load_signals().count()

    def load_signals(self) -> DataFrame:
        return artifacts.read_distillates(self.spark, self._signals)

    def skeleton(self, setting: cocreate.Setting, persona_id: str) -> dict:
        return cocreate.write_corpus(setting, self.config.workdir, persona_id, self._need())

    def interview(self, setting: cocreate.Setting, persona_id: str, rounds: int = 8) -> dict:
        return cocreate.interview(setting, rounds, self.config.workdir, persona_id, self._need())

    def write_method(self, folder: str | None = None) -> Path:
        """The method as a skill that agents can load."""
        return artifacts.write_method(folder or Path(self.config.workdir) / "skills")

    # whole runs

    def _count(self) -> Callable[[str], int]:
        return chunking.TokenCount(self.config.token_ranks) if self.config.token_ranks else len

    def _need(self) -> ModelClient:
        if self.ask is None:
            raise RuntimeError("this step needs a model")
        return self.ask

    def excerpts(self, name: str, top_n: int = 6) -> DataFrame:
        """The character's most telling entries of each category, by the three views where there is a scorer."""
        return profile.rerank_views(self.store.entries(name), top_n, self.score, ("character_name", "category"))

    def profile(self, name: str) -> DataFrame:
        entries = self.store.entries(name)
        if self.score:
            entries = self.score(entries.withColumn("query", F.lit(name))).drop("query")
        found = profile.profiles(entries, self.config.profile_max_entries, "score" if self.score else None)
        ask = self.ask
        return profile.with_summary(found, None if ask is None else (lambda p: flatten(ask(p))), lambda row: prompts.PROFILE.format(facts=row["summary"]))

    def rebuild(self, name: str, folder: str) -> list[Path]:
        """The character's corpus with other people's names replaced."""
        found, entries = self.profile(name), self.store.entries()
        people = profile.labels(profile.others(found, index.characters(entries), entries))
        row = profile.rebuilt(found, profile.replacements(people, found)).first()
        relations = profile.relationships(people, found).first()
        return artifacts.write_corpus(folder, row, [r.asDict() for r in relations.relations] if relations else [])

    def distill(self, path: str, persona_id: str = "persona", output: str | None = None, judge: bool = False) -> dict:
        """Files to a saved card."""
        c, began, ask = self.config, time.time(), self._need()
        retried = with_retry(ask)
        docs = self.load(path)
        chunks = chunking.chunk(docs.select(F.col("relpath").alias("source_file"), "text"), c.chunk_tokens, c.chunk_overlap, c.max_chunks, count=self._count())
        if c.extract_batch:
            extracted = distill.extract_batches(chunks, lambda p: structured(retried(p), dict), prompts.EXTRACTOR_BATCH, c.extract_batch)
        else:
            asked = chunks.withColumn("prompt", distill.extractor_prompt(F.col("source_file"), F.col("total_chunks")))
            extracted = distill.extract_signals(asked, lambda p: structured(retried(p), dict))
        at = f"{place(c.workdir)}/extracted-{uuid.uuid4().hex}"
        extracted.write.parquet(at)
        extracted = self.spark.read.parquet(at)
        counted = distill.gate(extracted)
        good = extracted.where("error is null").withColumn("schema_version", F.lit(1)).withColumn("ord", F.struct("source_file", "chunk_index")).withColumn("all", F.lit(1))
        self.save_signals(good)
        card = self._condense(good, persona_id)
        frame = self._card_frame(card)
        card["mental_models"] = [r.asDict(True) for r in self._verified(card, good)]
        card = self._backfilled(card, frame)
        skills = structured(retried(f"{prompts.skill_designer(c.max_skills)}\n\n{card['system_prompt']}"), dict).get("items", [])[: c.max_skills]
        names = {m["name"] for m in card["mental_models"]}
        for s in skills if names else []:
            s["mental_models"] = [m for m in s.get("mental_models") or [] if m["name"] in names]
        dialogues = structured(retried(f"{prompts.preset_dialogues(c.max_dialogues)}\n\n{card['system_prompt']}"), dict).get("items", [])[: c.max_dialogues]
        meta = counted | {"model": c.model, "n_docs": docs.count(), "elapsed_sec": round(time.time() - began, 1), "workdir": c.workdir}
        result = {"card": card, "skills": skills, "dialogues": dialogues, "metadata": meta}
        if judge:
            try:
                result["metadata"]["eval_report"] = self.evaluate(result, self.load_signals())
            except Exception as e:
                result["metadata"]["eval_error"] = str(e)
        if output:
            artifacts.save_result(output, result, good)
        return result

    def _condense(self, good: DataFrame, persona_id: str) -> dict:
        """One call for up to 30 distillates; else one for every 20, in the tasks, and one for their cards. Cards of more than 20
        calls are put together in rounds of 20, so no request holds more than that and no more come to the driver."""
        c, retried = self.config, with_retry(self._need())
        request = prompts.synthesizer(c.salience_threshold, persona_id)
        ask = lambda p: json.dumps(structured(retried(p), _card), ensure_ascii=False)
        bundles = distill.bundle(distill.batches_of_all(good, ["ord"]), ["batch_id"])
        cards = save(distill.ask_each(bundles.select("batch_id", F.concat(F.lit(f"{request}\n\n"), "bundle").alias("request")), ask), "cards")
        while cards.count() > distill.BATCH_SIZE:
            texts = cards.select(F.expr(f"batch_id div {distill.BATCH_SIZE}").alias("b"), "batch_id", F.get_json_object("reply", "$.system_prompt").alias("text"))
            joined = texts.groupBy(F.col("b").alias("batch_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("batch_id", "text"))), lambda x: x["text"]), "\n\n").alias("t"))
            cards = save(distill.ask_each(joined.select("batch_id", F.concat(F.lit(f"{request}\n\n"), "t").alias("request")), ask), "cards")
        found = [json.loads(r.reply) for r in cards.orderBy("batch_id").collect()]
        card = found[0] if len(found) == 1 else structured(retried("{}\n\n{}".format(request, "\n\n".join(x["system_prompt"] for x in found))), _card)
        return card | {"error_reply": card["error_reply"] or distill.ERROR_REPLY, "persona_id": persona_id}

    def _card_frame(self, card: dict) -> DataFrame:
        return self.spark.createDataFrame([(card["persona_id"], card["system_prompt"])], "persona_id string, system_prompt string")

    def _verified(self, card: dict, good: DataFrame) -> list:
        if not card["mental_models"]:
            return []
        rows = [(m["name"], m["principle"], m["verification"]) for m in card["mental_models"]]
        checked = distill.verify(self.spark.createDataFrame(rows, MODEL), distill.evidence_rows(good), "name")
        return checked.where("passed").select("name", "principle", "verification").collect()

    def _backfilled(self, card: dict, frame: DataFrame) -> dict:
        found = dna.extract(frame, "persona_id").first().asDict(True)
        out = dict(card)
        for k in ("mental_models", "decision_heuristics", "anti_patterns", "honest_boundaries"):
            out[k] = card[k] or found[k]
        out["expression_dna"] = {k: v or found["expression_dna"][k] for k, v in card["expression_dna"].items()}
        return out

    def evaluate(self, result: dict, distillates: DataFrame | None = None) -> dict:
        card, e = result["card"], result["card"]["expression_dna"]
        passed = sum(all(m["verification"][k] for k in ("cross_domain", "generative", "exclusive")) for m in card["mental_models"])
        row = (len(e["vocabulary"]), int(bool(e["rhythm"])), len(e["rhetorical_tics"]), len(e["signature_metaphors"]), len(e["opening_samples"]), len(card["mental_models"]), passed, len(card["anti_patterns"]), len(card["honest_boundaries"]), len(card["decision_heuristics"]))
        total = evaluate.coverage(self.spark.createDataFrame([row], ", ".join(f"{c} int" for c in evaluate.COUNTS))).first().total_score
        if self.ask is None:
            return evaluate.report(total)
        text = "(无原语料摘要)"
        if distillates is not None:
            with_order = distillates.withColumn("ord", F.struct("source_file", "chunk_index")).withColumn("all", F.lit(1))
            found = evaluate.corpus_digest(with_order, ["all"]).first()
            text = found.digest if found else text
        ask = lambda p: flatten(self.ask(p))
        return evaluate.report(total, evaluate.fidelity(ask, evaluate.card_digest(card), text), evaluate.identifiability(ask, card["persona_id"], card["display_name"], card["system_prompt"], text))

    def distill_character(self, name: str, persona_id: str, output: str | None = None) -> dict:
        """Rebuilds the character's corpus and distils it."""
        folder = str(Path(self.config.workdir) / "characters" / persona_id)
        self.rebuild(name, folder)
        return self.distill(folder, persona_id, output)
