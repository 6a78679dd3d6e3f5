"""The linkage dataflows: train, predict, ensemble, decide, post-process. Every stage boundary is a Parquet table under `work`."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.functions import constants as K
from kinlink.functions import translit
from kinlink.functions.address import parse_addresses
from kinlink.functions.name import parse_names
from kinlink.operators import blocking, decision, ensemble, features, model, relational, report, sampling
from kinlink.sources import tables

CHEAP = [
    "name_cos", "addr_cos", "n_ratio", "n_tsort", "n_tset", "n_partial", "n_jw", "c_ratio", "c_partial", "a_tset", "a_tsort", "street_ratio", "city_ratio", "q_native", "q_domain", "q_addr_empty", "q_src",
    "q_street_empty", "hn_q_empty", "hn_eq", "blk_score", "q_rank", "q_gap", "q_ncand", "s_rank", "s_ncand", "s_gap_top",
]
DETAILED = [
    "n_extra", "n_missing", "n_extra_short", "tok_jacc", "first_tok_eq", "q_ntok", "s_ntok", "name_exact", "name_sorted_eq", "s_subset_q", "q_subset_s", "legal_conflict", "legal_equal", "legal_q_only", "legal_s_only",
    "hn_rel", "hn_logdiff", "num_jacc", "num_q_only", "num_s_only", "qhn_in_snums", "qhn_min_logdist", "addr_alpha_jacc", "addr_alpha_q_only", "addr_alpha_s_only", "state_eq", "q_half", "hn_suffix_diff", "alt_q_tset",
    "alt_s_tset", "ident_jacc", "ident_q_only", "ident_s_only", "ident_edit_min", "ident_eq", "ident_replaced", "ident_added",
]
GROUP = [
    "p1", "p1_q_rank", "p1_q_gap", "p1_q_ncand", "p1_s_rank", "p1_s_ncand", "p1_s_gap_top", "anc_p1", "anc_strong", "anc_hn_eq_q", "anc_hn_eq_s", "anc_name_q", "anc_nums_jacc_q", "s_n_strong", "s_strong_hn_q",
    "s_strong_hn_s", "q_is_anchor", "peer_ex_share", "peer_ex_share_p", "peer_num_share", "peer_num_share_p", "peer_both", "q_n_extra_exact", "q_n_newnum", "s_n_cand_all",
]
TOKENS = ["ex_vocab_max", "ex_vocab_min", "ex_n_vocab", "ex_n_rare", "mi_vocab_max", "mi_vocab_min", "mi_n_vocab", "mi_n_rare", "substitution", "ex_mod_max", "ex_mod_n", "ex_qdf_max", "mi_mod_max", "mi_s1df_max", "mod_substitution"]
FREQUENCY = ["s_name_rate", "s_name_cnt", "q_name_rate", "q_name_cnt", "s_addr_cnt", "q_addr_cnt", "q_name_top"]
LEXICON = ["lex_extra_max", "lex_extra_min", "lex_extra_sum", "lex_miss_max", "lex_miss_min", "lex_miss_sum"]
STAGE2 = [*CHEAP, *DETAILED, *GROUP, *TOKENS, *FREQUENCY, *LEXICON]

PARSED = ["name_core", "legal", "name_alt", "native", "domain", "concat", "state", "hn", "hn_suf", "half", "nums", "addr_toks", "street", "city", "addr_empty", "idents", "src", "name"]


def saved(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def parse(records: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """records taken apart; table: (native, latin)."""
    if table is not None:
        records = translit.apply(records, table, "business_name", "entity_id", "__latin")
    out = parse_addresses(parse_names(records, latin="__latin" if table is not None else None)).drop("__latin")
    return out.withColumn("name", F.array_join(F.array_sort("name_core"), " "))


def sides(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Masters, and queries with empty states filled in from the masters' cities."""
    s = parsed.where("src = 1")
    q = relational.backfill_states(parsed.where("src > 1"), relational.learn_city_states(s)).drop("filled")
    return s, q


def block(s: DataFrame, q: DataFrame, cfg: dict) -> DataFrame:
    """Candidates with the first stage's features; context is taken inside each part, then of repeated pairs the first part's row stays."""
    terms = lambda df: df.withColumn("name_terms", blocking.trigrams(F.array_join("name_core", " "))).withColumn("addr_terms", blocking.address_terms(F.col("addr_toks"), F.col("hn"), F.col("street"), F.col("idents")))
    plan = blocking.partition_plan(s, q, K.NEIGHBOUR_STATES, cfg["k_block"], cfg["k_nostate"])
    pairs = blocking.prune(blocking.candidates(terms(s), terms(q), *plan), cfg["k_keep"], ["part", "q"])
    rows = features.cheap(features.with_records(pairs, s, q, PARSED))
    rows = relational.context(rows, "blk_score", part=["part"])
    order = [F.col("part").endswith("|-") | F.col("part").endswith("|s1"), F.col("part").endswith("|s1"), F.col("part")]
    return relational.keep_first(rows, order)


def stage2(pairs: DataFrame, s: DataFrame, q: DataFrame) -> DataFrame:
    """Survivors (with p1 and the first stage's columns) with all second-stage features but the lexicon's."""
    rows = features.detailed(pairs, K.STATE_GROUPS).withColumn("q_name", F.array_join("q_name_core", " "))
    grouped = features.group_features(rows)
    country = s.select(F.col("entity_id").alias("s1"), "country")
    rows = grouped.drop("country").join(country, "s1")
    vs, vq = features.vocabulary(s, "s1"), features.vocabulary(q, "q")
    rows = rows.join(features.vocabulary_features(rows, vs), ["s1", "q"]).join(features.modifier_features(rows, vs, vq), ["s1", "q"])
    keyed = lambda df: df.withColumn("addr_key", _key())
    frequency = features.frequency_features(rows.select("s1", "q"), keyed(s), keyed(q))
    return rows.join(frequency, ["s1", "q"])


def _key():
    from kinlink.functions.address import address_key

    return address_key(F.col("state"), F.col("idents"), F.col("hn"), F.col("street"), F.col("city"))


def train(spark: SparkSession, records: DataFrame, truth: DataFrame, work: str, cfg: dict | None = None, rounds: int | None = None, depth: int | None = None, refit: bool = False, dump: str | None = None) -> dict:
    """Fits both stages and writes models, tables and settings under `work`; returns the settings. records: entity_id, business_name,
    business_address, country, src; truth: s1, other.

    The first stage takes cfg `rounds1` rounds of trees of depth `depth1`, the second up to `rounds` of depth `depth2`, stopped where
    the validation masters' loss no longer falls; `rounds` and `depth`, if given, hold for both. With `refit` the second stage is then
    fitted to all rows with 1.15 times the rounds that it kept. `dump` names a folder for the second stage's features."""
    cfg = K.DEFAULTS | (cfg or {})
    names = records.select("entity_id", F.col("business_name").alias("name"))
    learned = translit.learn(truth.join(names.select(F.col("entity_id").alias("other"), F.col("name").alias("a")), "other").join(names.select(F.col("entity_id").alias("s1"), F.col("name").alias("b")), "s1").select("a", "b"))
    table = saved(translit.extend(learned, names), f"{work}/translit")
    parsed = saved(parse(records, table), f"{work}/parsed")
    s, q = sides(parsed)
    first = saved(relational.label_pairs(block(s, q, cfg), truth), f"{work}/candidates")
    scored, one = model.first_stage(first, CHEAP, rounds=rounds or cfg["rounds1"], depth=depth or cfg["depth1"])
    scored = saved(scored, f"{work}/stage1")
    floor = model.recall_threshold(scored, cfg["s1_recall"])
    second = saved(stage2(scored.where(F.col("p1") >= floor), s, q), f"{work}/stage2")
    held_in = second.where("not is_val")
    lexicon = saved(features.learn_lexicon(held_in.where("n_tset >= 80")), f"{work}/lexicon")
    folds = features.out_of_fold_lexicon(held_in, drop=cfg["lex_drop"])
    lexed = saved(held_in.join(folds, ["s1", "q"]).unionByName(second.where("is_val").join(features.apply_lexicon(second.where("is_val"), lexicon), ["s1", "q"])), f"{work}/features")
    if dump:
        tables.write_training_dump(lexed, s, q, dump)
    fit = {"depth": depth or cfg["depth2"], "negative_weight": cfg["neg_weight"]}
    two = model.train(lexed, STAGE2, rounds=rounds or cfg["rounds"], validation="is_val", **fit)
    validation = saved(model.score(two, lexed.where("is_val"), STAGE2), f"{work}/validation").select("s1", "q", "p", "y", "country")
    masters = s.select(F.col("entity_id").alias("s1"), "country").where(sampling.in_validation(F.col("s1"), cfg["val_pct"]))
    own = truth.join(masters.select("s1"), "s1", "left_semi")
    grid = [round(0.3 + 0.025 * i, 3) for i in range(27)]
    by_threshold = report.threshold_grid(masters, validation, own, grid, cfg["fp_weight"]).orderBy(F.desc("f05"), "threshold").first()
    expected = decision.assign_expected(validation, cfg["p_unfound"], cfg["min_p"])
    expected_f = report.macro_f(masters, expected, own, cfg["fp_weight"]).first().f05 or 0.0
    n = masters.count()
    use_expected = expected_f >= (by_threshold.f05 or 0.0)
    kept = expected if use_expected else decision.assign(validation, by_threshold.threshold)
    kept_rounds = two.getNumTrees
    if refit:
        two = model.train(lexed, STAGE2, rounds=-(-115 * kept_rounds // 100), **fit)
    meta = {
        "rounds": kept_rounds, "threshold": by_threshold.threshold, "val_f05": by_threshold.f05, "val_f05_expected": expected_f, "decision": "expected" if use_expected else "threshold", "stage1_threshold": floor,
        "target_mps": kept.count() / n if n else 0.0, "features1": CHEAP, "features2": STAGE2, "cfg": cfg,
    }
    one.write().overwrite().save(f"{work}/model1")
    two.write().overwrite().save(f"{work}/model2")
    tables.write_artifact(spark, meta, f"{work}/meta")
    return meta


def predict(spark: SparkSession, records: DataFrame, artifacts: str, out: str, calibrate: str | None = "shape", decide_by: str | None = None, selftrain: tuple[float, float] | None = None, threshold: float | None = None, overrides: dict[str, str] | None = None) -> DataFrame:
    """Scores records with a trained work folder, country by country in the data, and writes checkpoints (countries that have one are
    skipped), pair scores, candidate and matching lists; returns the matches. `threshold` takes the place of the trained one, and
    `overrides` names folders whose scores some countries are taken from."""
    meta = tables.read_artifact(spark, f"{artifacts}/meta")
    cfg = meta["cfg"]
    done = tables.checkpointed(spark, f"{out}/scores")
    todo = records.where(~F.col("country").isin(done)) if done else records
    if todo.limit(1).count():
        names = todo.select(F.col("business_name").alias("name"))
        table = saved(translit.extend(spark.read.parquet(f"{artifacts}/translit"), names), f"{out}/translit")
        parsed = saved(parse(todo, table), f"{out}/parsed")
        s, q = sides(parsed)
        first = model.score(GBTClassificationModel.load(f"{artifacts}/model1"), block(s, q, cfg), meta["features1"], "p1").where(F.col("p1") >= meta["stage1_threshold"])
        second = saved(stage2(saved(first, f"{out}/stage1"), s, q), f"{out}/stage2")
        lexicon, two = spark.read.parquet(f"{artifacts}/lexicon"), GBTClassificationModel.load(f"{artifacts}/model2")
        scored = saved(model.score(two, second.join(features.apply_lexicon(second, lexicon), ["s1", "q"]), meta["features2"]), f"{out}/scored")
        if selftrain:
            own = features.self_trained_lexicon(scored, lexicon, *selftrain)
            scored = saved(model.score(two, second.join(features.apply_lexicon(second.join(scored.select("s1", "q"), ["s1", "q"]), own), ["s1", "q"]), meta["features2"]), f"{out}/rescored")
        tables.write_checkpoint(scored.select("s1", "q", "p", "country"), f"{out}/scores")
    meta = meta | ({"threshold": threshold} if threshold is not None else {})
    scores = tables.read_scores_of(spark, f"{out}/scores", overrides or {})
    masters = records.where("src = 1").select(F.col("entity_id").alias("s1"), "country")
    kept = decide(scores, masters, meta, decide_by or meta["decision"], calibrate)
    tables.write_id_lists(tables.id_lists(masters, scores), f"{out}/candidate_pairs.tsv", ("source1_entity_id", "candidate_entity_ids"))
    tables.write_id_lists(tables.id_lists(masters, kept), f"{out}/matching_results.tsv", ("source1_entity_id", "matched_entity_ids"))
    return kept


def decide(scores: DataFrame, masters: DataFrame, meta: dict, by: str = "expected", calibrate: str | None = "shape", odds_div: float = 1.0, tol: float = K.DEFAULTS["tol"], unfound: float = K.DEFAULTS["p_unfound"]) -> DataFrame:
    """The kept pairs by one decision rule; `shape` holds the number of matches per master near the trained target."""
    n = masters.count()
    if by == "expected":
        if calibrate == "shape":
            return decision.calibrate_odds(scores, meta["target_mps"], n, tol, unfound=unfound)[0]
        return decision.assign_expected(scores, unfound, odds_div=odds_div)
    threshold = meta["threshold"]
    if calibrate == "shape":
        threshold = decision.calibrate_threshold(scores, threshold, meta["target_mps"], n, tol)
    return decision.assign(scores, threshold).select("s1", "q", "p")


def combine(spark: SparkSession, runs: list[str], weights: list[float] | None = None, zeros: bool = False) -> DataFrame:
    """Score checkpoints of several runs as one."""
    frames = [tables.read_scores(spark, r) for r in runs]
    return (ensemble.mean_with_zeros if zeros else ensemble.mean_of_scored)(frames, weights)


def stratify(scores: DataFrame, parsed: DataFrame, masters: int, reference: DataFrame, reference_masters: int, min_precision: float = 0.75) -> DataFrame:
    """Best pairs of the cells (band, number, name, legal form) that are precise enough in a labelled reference: best pairs with y and
    the parsed columns, such as celled() gives."""
    return decision.stratified_accept(celled(scores, parsed), masters, reference, reference_masters, min_precision).where("accepted").select("s1", "q", "p")


def celled(scores: DataFrame, parsed: DataFrame) -> DataFrame:
    best = relational.best_per_query(scores)
    return decision.cells(features.with_records(best, parsed, parsed, ["name_core", "legal", "hn"]))


def postprocess(scores: DataFrame, parsed: DataFrame, thresholds: dict[str, float], rescue_from: float = 0.5, sibling_countries: list[str] | None = None, camps: dict[str, float] | None = None, kinds: list[str] | None = None) -> DataFrame:
    """Thresholds by country, rescues under them, sibling drops and camp drops."""
    best = relational.best_per_query(scores).drop("country")
    full = features.with_records(best.join(parsed.select(F.col("entity_id").alias("s1"), "country"), "s1"), parsed, parsed, ["name_core", "legal", "hn", "street", "domain", "addr_empty"])
    t = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in thresholds.items() for x in kv)), F.col("country")), F.lit(0.75)) if thresholds else F.lit(0.75)
    kind = decision.rescue_kind(*(F.col(c) for c in ("s_name_core", "q_name_core", "q_domain", "s_hn", "q_hn", "s_street", "q_street", "q_addr_empty")))
    kept = full.where((F.col("p") >= t) | ((F.col("p") >= rescue_from) & (kind != "")))
    if sibling_countries:
        sibling = decision.sibling_signature(*(F.col(c) for c in ("s_name_core", "q_name_core", "s_legal", "q_legal", "s_hn", "q_hn")))
        kept = kept.where(~(F.col("country").isin(sibling_countries) & sibling))
    if camps:
        rows = kept.withColumn("s_core", F.array_sort(F.array_distinct("s_name_core"))).withColumn("q_core", F.array_sort(F.array_distinct("q_name_core")))
        kept = decision.drop_camps(rows, camps, kinds or ["num_same_core", "num_swap_core", "num_other_core", "name_swap"])
    return kept.select("s1", "q", "p", "country")
