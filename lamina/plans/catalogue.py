"""The catalogue of named queries. Results carry plain types: arrays and structs as text, dates as ISO strings."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import sinks
from ..functions import text as X
from ..operators import chunks as C, coverage, dedup, generate, pages as P, quality, review
from ..operators.deck import Deck, deck_from_generation, invalid_cards
from ..sources import files
from ..sources.decks import load_csv, load_parquet, resume
from ..storage import materialize, shared_dir, table
from ..streaming.reviews import activity_windows, review_stream
from . import fixtures as fx
from .oracles import ORACLES

QUERIES: dict = {}
AS_OF = "2024-06-30"


def query(f):
    QUERIES[f.__name__] = f
    return f


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "source")


def big(name: str):
    return F.col(name).cast("long").alias(name)


@query
def q01_normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").selectExpr("doc_id", f"{fx.ROUGH_TEXT} AS text").select("doc_id", X.normalize(F.col("text")).alias("text"))


@query
def q02_fingerprint(spark, sf_dir):
    lines = documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return lines.select("doc_id", big("pos"), X.fingerprint(F.col("line")).alias("fingerprint"))


@query
def q03_estimate_tokens(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", X.estimate_tokens(F.col("text")).cast("long").alias("tokens"))


@query
def q04_heading_flag(spark, sf_dir):
    lines = fx.markdown_pages(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n\n", -1)).alias("pos", "line"))
    return lines.select("doc_id", big("pos"), X.is_heading(X.strip(F.col("line"))).alias("heading"))


@query
def q05_card_text_normal_form(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", X.normal_form(F.col("text")).alias("form"))


@query
def q06_sentence_split(spark, sf_dir):
    parts = documents(spark, sf_dir).select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("pos", "sentence"))
    return parts.select("doc_id", big("pos"), "sentence")


@query
def q07_quality_kept(spark, sf_dir):
    return quality.filter_quality(fx.cards(spark, sf_dir)).deck.select("id", "question", "answer")


@query
def q08_quality_dropped(spark, sf_dir):
    return quality.filter_quality(fx.cards(spark, sf_dir)).dropped.select("id", "reason")


def _coverage(deck: DataFrame) -> DataFrame:
    out = coverage.coverage_by_topic(deck)
    return out.select("topic", *(big(c) for c in ("card_count", "easy", "medium", "hard")), F.array_join("card_types", "|").alias("card_types"))


@query
def q09_coverage_by_topic(spark, sf_dir):
    return _coverage(fx.cards(spark, sf_dir))


@query
def q10_card_mix(spark, sf_dir):
    return coverage.card_mix(fx.cards(spark, sf_dir))


@query
def q11_difficulty_mix(spark, sf_dir):
    return coverage.difficulty_mix(fx.cards(spark, sf_dir))


@query
def q12_keyword_search(spark, sf_dir):
    return coverage.keyword_search(fx.cards(spark, sf_dir), "the(re)?\\b")


@query
def q13_card_validation(spark, sf_dir):
    return fx.broken_cards(spark, sf_dir).select("id", quality.is_valid_card().alias("valid"))


def _state(deck: DataFrame) -> DataFrame:
    dates = [F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("due_date", "last_reviewed")]
    return deck.select("id", big("repetitions"), "ease_factor", big("interval_days"), *dates)


@query
def q14_srs_attach(spark, sf_dir):
    partial = fx.cards(spark, sf_dir).drop("document").withColumn("repetitions", F.expr("CASE WHEN id % 3 = 0 THEN 2 END")).withColumn("ease_factor", F.expr("CASE WHEN id % 3 = 0 THEN 2.25D END"))
    return _state(review.attach_review_state(partial))


@query
def q15_srs_single_review(spark, sf_dir):
    """The last review of each card, on a fresh state."""
    last = fx.reviews(spark, sf_dir).groupBy("id").agg(F.max_by(F.struct("at", "rating", "day"), "at").alias("r")).select("id", "r.*")
    return _state(review.apply_reviews(fx.review_deck(spark, sf_dir), last))


def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.apply_reviews(fx.review_deck(spark, sf_dir), fx.reviews(spark, sf_dir))


@query
def q16_srs_fold(spark, sf_dir):
    return _state(_folded(spark, sf_dir))


@query
def q17_due_cards(spark, sf_dir):
    return review.due_cards(_folded(spark, sf_dir), as_of=AS_OF).select("id", F.date_format("due_date", "yyyy-MM-dd").alias("due_date"))


@query
def q18_review_progress(spark, sf_dir):
    return review.review_progress(_folded(spark, sf_dir), as_of=AS_OF)


def _clean_stats(stats: dict) -> DataFrame:
    """Both reports counted in one pass over their union."""
    marked = stats["dropped_duplicates"].select(F.lit(1).alias("d")).unionByName(stats["dropped_quality"].select(F.lit(0).alias("d")))
    return marked.agg(F.count_if(F.col("d") == 1).alias("duplicates_dropped"), F.count_if(F.col("d") == 0).alias("quality_dropped"))


@query
def q19_clean_stats(spark, sf_dir):
    return _clean_stats(Deck(fx.cards(spark, sf_dir)).clean(duplicate_threshold=1.0)[1])


@query
def q19b_near_clean_stats(spark, sf_dir):
    return _clean_stats(Deck(fx.cards(spark, sf_dir)).clean()[1])


@query
def q20_document_stats(spark, sf_dir):
    pages = P.finalize(fx.raw_pages(spark, sf_dir)).filter("text <> ''")
    return P.document_stats(pages).select("source", F.sha2("text", 256).alias("text_sha256"), big("page_count"), big("char_count"))


@query
def q21_running_lines_removed(spark, sf_dir):
    return P.strip_running_lines(fx.raw_pages(spark, sf_dir)).select("source", big("page"), "text")


@query
def q22_paragraphs(spark, sf_dir):
    pages = fx.markdown_pages(spark, sf_dir).select("doc_id", "text").unionByName(documents(spark, sf_dir).select((-1 - F.col("doc_id")).alias("doc_id"), "text"))
    return pages.select("doc_id", F.posexplode(X.paragraphs(F.col("text"))).alias("pos", "text")).select("doc_id", big("pos"), "text")


@query
def q23_heading_blocks(spark, sf_dir):
    return C.split_blocks(fx.markdown_pages(spark, sf_dir)).select("source", big("pos"), "text")


@query
def q24_oversized_split(spark, sf_dir):
    """Sentences and words grouped under 60 tokens."""
    return documents(spark, sf_dir).select("doc_id", F.posexplode(C.hard_split(F.col("text"), 60)).alias("pos", "piece")).select("doc_id", big("pos"), "piece")


def _packed(spark: SparkSession, sf_dir: str, merge: bool) -> DataFrame:
    blocks = C.explode_oversized(C.split_blocks(fx.markdown_pages(spark, sf_dir)), 200)
    out = C.pack_blocks(blocks, 200, 60, merge_runts=merge)
    return out.select("source", *(big(c) for c in ("index", "start_page", "end_page", "token_count")), "text")


@query
def q25_greedy_pack(spark, sf_dir):
    return _packed(spark, sf_dir, False)


@query
def q26_runt_merge(spark, sf_dir):
    return _packed(spark, sf_dir, True)


@query
def q27_chunk_index_global(spark, sf_dir):
    pages = fx.markdown_pages(spark, sf_dir)
    out = C.chunk_documents(pages, max_tokens=200, min_tokens=60, document_order="doc_id")
    return out.select(big("index"), "source", big("token_count"), X.page_label(F.col("start_page"), F.col("end_page")).alias("label"))


@query
def q27b_chunk_totals(spark, sf_dir):
    """Documents, chunks and estimated tokens."""
    pages = fx.markdown_pages(spark, sf_dir)
    return C.chunk_totals(C.chunk_documents(pages, max_tokens=200, min_tokens=60, document_order="doc_id"))


@query
def q28_exact_dup_clusters(spark, sf_dir):
    out = dedup.find_near_duplicates(fx.cards(spark, sf_dir), threshold=1.0)
    return out.select(big("keeper"), F.array_join(F.transform("ids", lambda i: i.cast("string")), "|").alias("ids"))


@query
def q29_near_dup_pairs(spark, sf_dir):
    return dedup.similar_pairs(fx.cards(spark, sf_dir))


@query
def q30_deduplicate_kept(spark, sf_dir):
    return dedup.deduplicate(fx.cards(spark, sf_dir), threshold=1.0).deck.select("id", "question")


@query
def q30b_near_deduplicate_kept(spark, sf_dir):
    return dedup.deduplicate(fx.cards(spark, sf_dir)).deck.select("id", "question")


@query
def q31_deduplicate_dropped(spark, sf_dir):
    return dedup.deduplicate(fx.cards(spark, sf_dir), threshold=1.0).dropped.select("id", "duplicate_of")


@query
def q31b_near_deduplicate_dropped(spark, sf_dir):
    return dedup.deduplicate(fx.cards(spark, sf_dir)).dropped.select("id", "question", "duplicate_of")


@query
def q32_grounding_filter(spark, sf_dir):
    """Each card against its own document."""
    own = fx.cards(spark, sf_dir).withColumn("chunk_index", F.col("id"))
    chunks = documents(spark, sf_dir).select(F.col("doc_id").cast("int").alias("index"), "text")
    return generate.grounded(own, chunks).select("id", "is_grounded")


@query
def q33_generation_totals(spark, sf_dir):
    return generate.generation_totals(fx.generation(spark, sf_dir))


@query
def q34_generation_errors(spark, sf_dir):
    return fx.generation(spark, sf_dir).filter("error IS NOT NULL").select(big("chunk_index"), "error")


@query
def q35_deck_from_summary(spark, sf_dir):
    chunks = spark.range(0, 30).select(F.col("id").cast("int").alias("index"), F.concat(F.lit("file"), F.col("id").cast("string")).alias("source"))
    return deck_from_generation(fx.generation(spark, sf_dir), chunks).select(big("id"), "question", big("chunk_index"), "document")


@query
def q36_anki_rows(spark, sf_dir):
    return fx.cards(spark, sf_dir).filter("topic IS NOT NULL").select("id", sinks.anki_line().alias("line"))


@query
def q37_quizlet_rows(spark, sf_dir):
    return fx.cards(spark, sf_dir).select("id", sinks.quizlet_line().alias("line"))


@query
def q38_json_rows(spark, sf_dir):
    """The lines' fields read back: both engines agree on values rather than on spacing."""
    from ..schemas import CARD

    line = F.from_json(sinks.json_line(), CARD[len("struct<") : -1].replace(":", " "))
    return fx.cards(spark, sf_dir).select("id", line.alias("c")).select("id", "c.question", "c.answer", "c.topic")


def _saved(spark: SparkSession, sf_dir: str, save, load) -> DataFrame:
    path = f"{shared_dir(spark)}/lamina/deck-{uuid.uuid4().hex}"
    save(fx.cards(spark, sf_dir), path)
    return load(spark, path)


@query
def q39_deck_roundtrip_parquet(spark, sf_dir):
    return _saved(spark, sf_dir, sinks.save_parquet, load_parquet)


@query
def q39b_deck_roundtrip_csv(spark, sf_dir):
    return _saved(spark, sf_dir, sinks.save_csv, load_csv)


@query
def q40_clean_pipeline(spark, sf_dir):
    """Deduplicate, filter by quality, report coverage."""
    deck, _ = Deck(fx.cards(spark, sf_dir)).clean(duplicate_threshold=1.0)
    return _coverage(deck.df)


@query
def q40b_near_clean_pipeline(spark, sf_dir):
    """The same with duplicates by similarity, at the operator's default."""
    deck, _ = Deck(fx.cards(spark, sf_dir)).clean()
    return _coverage(deck.df)


@query
def q41_prompts(spark, sf_dir):
    chunks = C.chunk_documents(fx.markdown_pages(spark, sf_dir), max_tokens=200, min_tokens=60, document_order="doc_id")
    return chunks.select(big("index"), F.sha2(generate.prompt_column(), 256).alias("prompt_sha256"))


@query
def q42_upload_totals(spark, sf_dir):
    return files.upload_totals(P.finalize(fx.raw_pages(spark, sf_dir)).filter("text <> ''"))


@query
def q43_generate_deck(spark, sf_dir):
    """Chunks through a rule that makes cards, grounded and counted."""
    chunks = materialize(C.chunk_documents(fx.markdown_pages(spark, sf_dir), max_tokens=200, min_tokens=60, document_order="doc_id"), "chunks")
    out = generate.generate_deck(chunks, RuleProvider, count_per_chunk=2)
    return out.select(big("chunk_index"), F.size("cards").cast("long").alias("cards"), big("dropped_ungrounded"), big("input_tokens"), "stop_reason", "error")


def _counted(text: str) -> int:
    """The estimate of tokens, as a counter that only Python can call."""
    return max(1, int(len(text) / X.CHARS_PER_TOKEN))


@query
def q45_ingest_files(spark, sf_dir):
    """All documents as files: text of known and unknown bytes to normalised pages."""
    name = F.concat(F.lit("n"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".md").otherwise(".TXT"))
    data = table(spark, sf_dir, "documents").select(name.alias("source"), F.encode(F.expr(fx.ROUGH_TEXT), "UTF-8").alias("content"))
    pages, _ = files.ingest(data)
    return pages.select("source", big("page"), "text")


@query
def q45b_ingest_errors(spark, sf_dir):
    """Files that cannot be read, with the reason."""
    kind = F.when(F.col("doc_id") % 3 == 0, ".pptx").otherwise(".md")
    body = F.when(F.col("doc_id") % 5 == 0, F.lit(" \n ")).otherwise(F.col("text"))
    data = table(spark, sf_dir, "documents").select(F.concat(F.lit("n"), F.col("doc_id").cast("string"), kind).alias("source"), F.encode(body, "UTF-8").alias("content"))
    return files.ingest(data)[1]


@query
def q46_resume_snapshot(spark, sf_dir):
    """A saved deck read again, its review state filled up."""
    path = f"{shared_dir(spark)}/lamina/snapshot-{uuid.uuid4().hex}"
    sinks.save_snapshot(fx.cards(spark, sf_dir).filter(quality.is_valid_card()), path)
    return _state(resume(spark, path))


@query
def q47_record_review(spark, sf_dir):
    """One review of one card; the rest of the deck stays."""
    return _state(review.record_review(fx.cards(spark, sf_dir), 7, "easy", today="2024-05-01"))


@query
def q48_export_gate(spark, sf_dir):
    """The cards that block an export."""
    return invalid_cards(fx.broken_cards(spark, sf_dir)).select("id")


@query
def q49_injected_counter(spark, sf_dir):
    """Chunks with a token counter that only Python can call."""
    out = C.chunk_documents(fx.markdown_pages(spark, sf_dir), max_tokens=200, min_tokens=60, token_counter=_counted, document_order="doc_id")
    return out.select(big("index"), "source", big("token_count"), X.page_label(F.col("start_page"), F.col("end_page")).alias("label"))


@query
def q50_review_stream(spark, sf_dir):
    """All reviews as a stream: the state after each of them."""
    path = f"{shared_dir(spark)}/lamina/stream-{uuid.uuid4().hex}"
    reviews = materialize(fx.reviews(spark, sf_dir).select(F.col("id").cast("long").alias("id"), "ts", "rating"), "reviews")
    stream = review_stream(spark.readStream.schema(reviews.schema).parquet(reviews.inputFiles()[0].rsplit("/", 1)[0]))
    run = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    out = spark.read.schema(stream.schema).parquet(f"{path}/out")
    dates = [F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("due_date", "last_reviewed")]
    return out.select("id", big("repetitions"), "ease_factor", big("interval_days"), *dates)


@query
def q51_activity_windows(spark, sf_dir):
    """Reviews for each hour and rating."""
    out = activity_windows(fx.reviews(spark, sf_dir).select("ts", "rating"))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select(stamp("start"), stamp("end"), "rating", "reviews")


class RuleProvider:
    """A deterministic provider: a card of each chunk's beginning, one that is not grounded, refusals by rule."""

    def __call__(self, request):
        chunk = request["chunk"]
        if chunk["index"] % 7 == 3:
            return {"cards": None, "stop_reason": "refusal", "category": "rule", "input_tokens": len(chunk["text"])}
        card = {"question": f"What does passage {chunk['index']} say?", "answer": chunk["text"][:60], "card_type": "concept", "difficulty": "easy", "topic": chunk["source"], "source_excerpt": chunk["text"][:40]}
        return {"cards": [card, card | {"source_excerpt": "a passage that is nowhere"}], "stop_reason": "end_turn", "input_tokens": len(chunk["text"]), "output_tokens": 10}


@query
def q44_edits_merged(spark, sf_dir):
    deck = fx.cards(spark, sf_dir)
    edits = deck.filter("id % 10 = 0").select("id", F.concat(F.lit("edited "), F.col("question")).alias("question"))
    return review.apply_edits(deck, edits, deck.filter("id % 25 = 5")).select("id", "question", "answer")


