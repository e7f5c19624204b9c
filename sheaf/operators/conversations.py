"""Conversation budgets, trimming, compression and repetition checks.

Messages are ``(conv_id, turn, role, text)`` with ``turn`` the 0-based position in the conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions.skew import BLOCK, running, top_k
from ..functions.text import WORD, clip, col, first_sentence, joined, message_cost, strip, token_count
from ..session import cut_lineage
from .retrieval import RULE, heuristic_rerank, rerank_sandwich

CHUNK_MESSAGES = 12
CHUNK_TOKENS = 150
SESSION_TOKENS = 300


# --- tokens and budgets ------------------------------------------------------------------------------

def message_tokens(messages: DataFrame) -> DataFrame:
    """Tokens per conversation. Optional columns: ``parts`` (multimodal texts, instead of ``text``) and
    ``tool_calls`` (array of name/arguments)."""
    cost = F.lit(4) + token_count("text")
    if "parts" in messages.columns:
        parts = F.aggregate("parts", F.lit(0), lambda acc, p: acc + token_count(p))
        cost = F.lit(4) + F.when(F.col("parts").isNotNull(), parts).otherwise(token_count("text"))
    if "tool_calls" in messages.columns:
        calls = F.aggregate("tool_calls", F.lit(0), lambda acc, c: acc + token_count(c["arguments"]) + token_count(c["name"]))
        cost = cost + F.coalesce(calls, F.lit(0))
    return messages.groupBy("conv_id").agg((F.sum(cost) + 3).alias("tokens"))


def model_context_size(model: Column | str, first_prefix: bool = False) -> Column:
    """Context window of a model: exact name, else the longest known prefix (or the first in table order)."""
    c = col(model)
    exact = [F.when(c == name, size) for name, size in fixed.MODEL_CONTEXT_SIZES]
    table = fixed.MODEL_CONTEXT_SIZES if first_prefix else sorted(fixed.MODEL_CONTEXT_SIZES, key=lambda r: -len(r[0]))
    prefix = [F.when(c.startswith(name), size) for name, size in table]
    return F.coalesce(*exact, *prefix, F.lit(fixed.DEFAULT_CONTEXT_SIZE))


def context_budget(context_size: Column, reserve: Column) -> Column:
    left = context_size - reserve
    return F.when(left <= 0, F.floor(context_size / 2)).otherwise(left)


def trim_messages(messages: DataFrame, budgets: DataFrame, block: int = BLOCK) -> DataFrame:
    """Leading system message plus the newest messages that fit ``budgets(conv_id, budget)``.

    Costs are positive, so stopping at the first overflow equals a running sum staying within the budget.
    """
    costed = messages.withColumn("_cost", message_cost("text")).withColumn(
        "_lead", (F.col("turn") == 0) & (F.col("role") == "system"))
    body = F.when(F.col("_lead"), 0).otherwise(F.col("_cost"))
    run = running(costed, ["conv_id"], "turn", {"_used": ("sum", body)}, block=block, descending=True)
    totals = costed.groupBy("conv_id").agg((F.sum(F.col("_cost") - 3) + 3).alias("_total"),
                                           F.sum(F.when(F.col("_lead"), F.col("_cost")).otherwise(0)).alias("_sys"))
    limits = totals.join(budgets, "conv_id")
    kept = run.join(limits, "conv_id").filter(
        F.col("_lead") | (F.col("_total") <= F.col("budget")) | (F.col("_used") <= F.col("budget") - F.col("_sys")))
    return kept.select(*messages.columns)


BUDGETS = ("total_available", "instruction", "summary", "verbatim_history", "recap", "dedup", "rag")


def adaptive_budgets(sizes: DataFrame, context_size: int = 8192, reserve: int = fixed.COMPLETION_RESERVE) -> DataFrame:
    """Section budgets from (conv_id, turns, system_tokens, current_tokens): deeper talk, more compression."""
    total = F.lit(context_size - reserve) - F.col("system_tokens") - F.col("current_tokens")
    depth = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("turns") - 5) / 45.0))
    share = lambda ratio: (F.col("_t") * ratio).cast("int")
    base = sizes.withColumn("_t", total.cast("int")).withColumn("depth_factor", depth)
    some = base.withColumn("instruction", F.least(share(F.lit(0.03)), F.lit(200))) \
        .withColumn("summary", share(F.lit(0.05) + F.col("depth_factor") * 0.15)) \
        .withColumn("recap", share(F.lit(0.12))) \
        .withColumn("dedup", F.when(F.col("turns") > 10, share(F.lit(0.05))).otherwise(0)) \
        .withColumn("rag", share(F.lit(0.15)))
    fixed_part = F.col("instruction") + F.col("summary") + F.col("recap") + F.col("dedup") + F.col("rag")
    ratio = F.lit(0.60) + F.col("depth_factor") * F.lit(0.40 - 0.60)
    some = some.withColumn("verbatim_history", F.greatest(F.lit(0), share(ratio) - fixed_part)) \
        .withColumn("total_available", F.greatest(F.lit(0), "_t"))
    none = F.col("_t") <= 0
    return some.select("conv_id", "turns", "depth_factor", *[
        F.when(none, 0).otherwise(F.col(c)).cast("int").alias(c) for c in BUDGETS])


def history_sizes(messages: DataFrame) -> DataFrame:
    return messages.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_messages"), F.count_if(F.col("role").isin("user", "assistant")).alias("turns"))


# --- summaries ---------------------------------------------------------------------------------------

def point(user_limit: int, assistant_limit: int, user_label: str, assistant_label: str) -> Column:
    """What a message contributes to a summary; null when nothing."""
    s = first_sentence("text")
    user, answer = clip(s, user_limit, "..."), clip(s, assistant_limit, "...")
    return (F.when((F.col("role") == "user") & (s != ""), F.concat(F.lit(user_label), user))
            .when((F.col("role") == "assistant") & (F.length(answer) > 10), F.concat(F.lit(assistant_label), answer)))


def chunk_summaries(messages: DataFrame, messages_per_chunk: int = CHUNK_MESSAGES) -> DataFrame:
    """(conv_id, chunk, start_turn, end_turn, summary, tokens) for the completed chunks.

    Chunk k takes messages k*p .. k*p+p-1 and counts as p/2 turns; as many chunks count as complete as half
    chunks of user and assistant messages exist.
    """
    p, half = messages_per_chunk, messages_per_chunk // 2
    chunk = F.floor(F.col("turn") / p).cast("int")
    per_chunk = messages.withColumn("_p", point(80, 100, "User asked: ", "Answered: ")).groupBy(
        "conv_id", chunk.alias("chunk")).agg(F.collect_list(F.when(F.col("_p").isNotNull(), F.struct("turn", "_p"))).alias("_ps"))
    text = F.array_join(F.slice(F.transform(F.array_sort("_ps"), lambda r: r["_p"]), 1, 6), " | ")
    complete = history_sizes(messages).select("conv_id", F.floor(F.col("turns") / half).alias("_n"))
    kept = per_chunk.join(complete, "conv_id").filter(F.col("chunk") < F.col("_n")).withColumn("_s", text)
    summary = F.when(token_count("_s") > CHUNK_TOKENS, F.substring("_s", 1, CHUNK_TOKENS * 4)).otherwise(F.col("_s"))
    return kept.withColumn("summary", summary).select(
        "conv_id", "chunk", (F.col("chunk") * half).alias("start_turn"), ((F.col("chunk") + 1) * half).alias("end_turn"),
        "summary", token_count("summary").alias("tokens"))


def _chunk_line() -> Column:
    return F.concat(F.lit("[Turns "), "start_turn", F.lit("-"), "end_turn", F.lit("]: "), "summary")


#: '[Turns a-b]: ' and a summary of a character.
SHORTEST_LINE = 14


def session_summary(chunks: DataFrame) -> DataFrame:
    """(conv_id, overview, overview_tokens, n_chunks) for conversations with two chunks or more.

    A line has at least ``SHORTEST_LINE`` characters, so the lines that the overview's characters can hold decide it.
    """
    counts = chunks.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    first = top_k(chunks, ["conv_id"], [F.col("chunk")], SESSION_TOKENS * 4 // SHORTEST_LINE + 1, "_rn")
    texts = first.groupBy("conv_id").agg(joined("\n\n", _chunk_line(), "chunk").alias("_t"))
    cut = F.when(token_count("_t") > SESSION_TOKENS, F.substring("_t", 1, SESSION_TOKENS * 4)).otherwise(F.col("_t"))
    return counts.filter("n_chunks >= 2").join(texts, "conv_id").withColumn("overview", cut).select(
        "conv_id", "overview", token_count("overview").alias("overview_tokens"), "n_chunks")


def compressed_context(chunks: DataFrame, recent: DataFrame, messages_per_chunk: int = CHUNK_MESSAGES) -> DataFrame:
    """Overview and chunk lines before the recent turns, ``recent(conv_id, recent_turns)``."""
    half = messages_per_chunk // 2
    early = chunks.join(recent, "conv_id").filter(F.col("start_turn") < F.floor(F.col("recent_turns") / half) * half)
    lines = early.select("conv_id", (F.col("chunk") + 1).alias("pos"), _chunk_line().alias("line"))
    top = session_summary(chunks).join(recent, "conv_id").select(
        "conv_id", F.lit(0).alias("pos"), F.concat(F.lit(fixed.OVERVIEW_HEADING), "overview").alias("line"))
    return top.unionByName(lines).groupBy("conv_id").agg(joined("\n\n", "line", "pos").alias("compressed"))


def recap(messages: DataFrame, points: int = 8) -> DataFrame:
    """Key points of the first contributing messages as a bullet list (conv_id, recap)."""
    spoken = messages.withColumn("_p", point(120, 150, "User asked: ", "Assistant: ")).filter(F.col("_p").isNotNull())
    first = top_k(spoken, ["conv_id"], [F.col("turn")], points, "_rn")
    bullets = joined("\n", F.concat(F.lit("- "), "_p"), "turn")
    return first.groupBy("conv_id").agg(F.concat(F.lit(fixed.RECAP_HEADING), bullets).alias("recap"))


# --- repetition --------------------------------------------------------------------------------------

def dedup_tokens(text: Column | str) -> Column:
    found = F.regexp_extract_all(F.lower(col(text)), F.lit(f"({WORD})"), 1)
    stops = F.array(*[F.lit(w) for w in fixed.DEDUP_STOP_WORDS])
    return F.filter(F.array_except(found, stops), lambda w: F.length(w) > 1)


def jaccard(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared / (F.size(a) + F.size(b) - shared))


def repetition_guard(history: DataFrame, current: DataFrame, threshold: float = 0.6, pairs: int = 10, shown: int = 3) -> DataFrame:
    """Hints for conversations whose current message (conv_id, message) resembles an answered question.

    The newest questions and answers are aligned from the end; (conv_id, n_similar, hint).
    """
    newest = [F.col("turn").desc()]
    asked = top_k(history.filter("role = 'user'"), ["conv_id"], newest, pairs, "back").select("conv_id", "back", F.col("text").alias("_q"))
    told = top_k(history.filter("role = 'assistant'"), ["conv_id"], newest, pairs, "back").select("conv_id", "back", F.col("text").alias("_a"))
    both = asked.join(told, ["conv_id", "back"]).join(current, "conv_id")
    sim = jaccard(dedup_tokens("message"), dedup_tokens("_q"))
    alike = both.withColumn("_sim", sim).filter(F.col("_sim") >= threshold)
    brief = strip(F.replace(F.substring("_a", 1, 150), F.lit("\n"), F.lit(" ")))
    brief = F.when(F.length(brief) >= 150, F.concat(brief, F.lit("..."))).otherwise(brief)
    topics = alike.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(
        "back", F.substring("_q", 1, 80).alias("q"), F.bround(F.col("_sim") * 100, 0).cast("int").alias("pct"), brief.alias("brief")))).alias("_t"))
    line = lambda t, i: F.concat(i + 1, F.lit(". You already answered about '"), t["q"], F.lit("' (similarity: "), t["pct"],
                                 F.lit("%): "), t["brief"])
    return topics.select("conv_id", F.size("_t").alias("n_similar"), F.concat(
        F.lit(fixed.REPEAT_HEADING), F.array_join(F.transform(F.slice("_t", 1, shown), line), "\n")).alias("hint"))


# --- fitting -----------------------------------------------------------------------------------------

def fit_history(history: DataFrame, limits: DataFrame, chunk_counts: DataFrame, messages_per_chunk: int = CHUNK_MESSAGES,
                block: int = BLOCK) -> DataFrame:
    """Messages kept within ``limits(conv_id, token_budget, recap_budget)``.

    Messages covered by chunk summaries are skipped unless that would be all of them; then everything if it
    fits, else the newest that fit. Adds ``all_fit`` and ``was_compressed``.
    """
    facts = history.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_n")).join(chunk_counts, "conv_id", "left").join(
        limits, "conv_id").select(
        "conv_id", "_n", (F.col("token_budget") - F.col("recap_budget")).alias("_main"),
        (F.coalesce("n_chunks", F.lit(0)) * messages_per_chunk).alias("_c")).withColumn(
        "_skip", F.when(F.col("_c") < F.col("_n"), F.col("_c")).otherwise(0))
    recent = history.join(facts, "conv_id").filter(F.col("turn") >= F.col("_skip")).withColumn("_cost", message_cost("text"))
    totals = recent.groupBy("conv_id").agg((F.sum(F.col("_cost") - 3) + 3).alias("_total"))
    run = running(recent, ["conv_id"], "turn", {"_used": ("sum", F.col("_cost"))}, block=block, descending=True)
    kept = run.join(totals, "conv_id").withColumn("all_fit", F.col("_total") <= F.col("_main")).filter(
        F.col("all_fit") | (F.col("_used") <= F.col("_main")))
    sizes = kept.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_kept"))
    return kept.join(sizes, "conv_id").withColumn("was_compressed", F.col("n_kept") < F.col("_n")).select(
        *history.columns, "all_fit", "was_compressed", "n_kept")


def fitted_recap(kept: DataFrame, limits: DataFrame) -> DataFrame:
    """Recap of fitted histories long enough for one (6 messages when all fit, else 4), cut to its budget."""
    long = kept.filter(F.col("n_kept") >= F.when(F.col("all_fit"), 6).otherwise(4))
    cut = F.when(token_count("recap") > F.col("recap_budget"), F.expr("substring(recap, 1, recap_budget * 4)")).otherwise(F.col("recap"))
    return recap(long).join(limits.select("conv_id", "recap_budget"), "conv_id").select("conv_id", cut.alias("recap"))


def relevance_split(kept: DataFrame, current: DataFrame) -> DataFrame:
    """``section`` key/older for fitted (token-bounded) histories: the half closer to the current message is key.

    Up to four messages are all key; without a message to compare with, the first two thirds are.
    """
    per_conv = W.partitionBy("conv_id")
    rows = kept.join(current, "conv_id", "left").select(
        *kept.columns, F.count(F.lit(1)).over(per_conv).alias("_n"), F.col("message").isNotNull().alias("_asked"),
        F.col("conv_id").alias("query_id"), F.coalesce("message", F.lit("")).alias("query"),
        (F.col("turn") - F.min("turn").over(per_conv)).alias("idx"))
    own = [c for c in rows.columns if c != "text"]
    ranked = heuristic_rerank(rows.withColumn("_full", F.col("text")).withColumn(
        "text", F.concat("role", F.lit(": "), F.substring("text", 1, 200))))
    third = F.greatest(F.lit(2), F.floor(F.col("_n") * 2 / 3))
    key = (F.when(F.col("_n") <= 4, True).when(F.col("_asked"), F.col("rank") < F.floor(F.col("_n") / 2))
           .otherwise(F.col("idx") < third))
    return ranked.select(*own, F.col("_full").alias("text"), F.when(key, "key").otherwise("older").alias("section")).select(
        *kept.columns, "section")


def instruction_rules(prompt: Column | str, limit: int = 5) -> Column:
    """Rule sentences of a prompt under their heading, '' without any; a row-local list, no shuffle."""
    found = F.concat(*[F.regexp_extract_all(col(prompt), F.lit(f"(?i)({p})"), 1) for p in fixed.RULE_PATTERNS])
    lowered = F.transform(found, lambda r: strip(F.lower(r)))
    first = F.filter(found, lambda r, i: F.array_position(lowered, strip(F.lower(r))) == i + 1)
    lines = F.transform(F.slice(first, 1, limit), lambda r: F.concat(F.lit("- "), strip(r)))
    return F.when(F.size(found) == 0, "").otherwise(F.concat(F.lit(fixed.RULES_HEADING), F.array_join(lines, "\n")))


def split_context_blocks(contexts: DataFrame) -> DataFrame:
    """Stripped, non-empty blocks of rag contexts (query_id, query, rag_context) as reranking candidates."""
    blocks = F.filter(F.transform(F.split("rag_context", "\\n---\\n|\\n##\\s"), strip), lambda b: b != "")
    return contexts.select("query_id", "query", F.posexplode(blocks).alias("idx", "text"))


def sandwich_context(contexts: DataFrame) -> DataFrame:
    """Contexts (query_id, query, rag_context, budget) fitted to their token budget, best blocks at the edges."""
    placed = rerank_sandwich(split_context_blocks(contexts))
    ordered = placed.groupBy("query_id").agg(joined(RULE, "text", "pos").alias("_s"), F.count(F.lit(1)).alias("_n"))
    cut = lambda c: F.expr(f"substring({c}, 1, budget * 4)")
    return contexts.join(ordered, "query_id", "left").select("query_id", F.when(
        F.coalesce("_n", F.lit(0)) <= 2, cut("rag_context")).when(
        token_count("_s") > F.col("budget"), cut("_s")).otherwise(F.col("_s")).alias("context"))


# --- whole message lists -----------------------------------------------------------------------------

def build_messages(requests: DataFrame, history: DataFrame, *, context_size: int = 8192, reserve: int = fixed.COMPLETION_RESERVE,
                   messages_per_chunk: int = CHUNK_MESSAGES, threshold: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """Final message lists and their metadata for requests (conv_id, system_prompt, message, memory_context, rag_context).

    Section order: prompt, rules, summary, memory, guidance, retrieved context, key history, older history,
    repetition guard, recap, current message; then the list is trimmed to the context window. Returns
    (conv_id, pos, section, role, content) and one meta row per conversation.

    Intermediate tables that several sections read are checkpointed once, so the plan stays small.
    """
    requests = cut_lineage(requests)
    current = requests.select("conv_id", "message")
    sizes = requests.join(history_sizes(history), "conv_id", "left").select(
        "conv_id", F.coalesce("turns", F.lit(0)).alias("turns"), F.coalesce("n_messages", F.lit(0)).alias("n_messages"), (token_count("system_prompt") + 10).alias("system_tokens"),
        (token_count("message") + 4).alias("current_tokens"))
    budgets = adaptive_budgets(sizes, context_size, reserve)
    history = cut_lineage(history)
    chunks = cut_lineage(chunk_summaries(history, messages_per_chunk))
    recent = budgets.select("conv_id", F.greatest(F.lit(4), F.floor(F.col("verbatim_history") / 200)).alias("recent_turns"))
    compressed = compressed_context(chunks, recent, messages_per_chunk)

    head = requests.join(budgets, "conv_id").join(compressed, "conv_id", "left").withColumn(
        "_rag", F.nullif("rag_context", F.lit(""))).withColumn(
        "_rag_full", F.lit(3 + 4 + 4) + token_count(F.concat(F.lit(fixed.RAG_HEADING), "_rag")) + token_count(F.lit(fixed.RAG_REPLY)))
    tight = head.filter(F.col("_rag").isNotNull() & (F.col("_rag_full") >= F.col("rag"))).select(
        F.col("conv_id").alias("query_id"), F.col("message").alias("query"), "rag_context", F.col("rag").alias("budget"))
    fitted = sandwich_context(tight).select(F.col("query_id").alias("conv_id"), F.col("context").alias("_fit"))
    summary = F.when(token_count("compressed") > F.col("summary"), F.expr("substring(compressed, 1, summary * 4)")).otherwise(F.col("compressed"))
    shown_rag = F.nullif(F.coalesce("_fit", "_rag"), F.lit(""))
    rag = F.concat(F.lit(fixed.RAG_HEADING), shown_rag)
    msg = lambda no, role, content: F.struct(F.lit(no).alias("section"), F.lit(role).alias("role"), content.alias("content"))
    some = lambda c: F.nullif(c, F.lit(""))
    opening = F.filter(F.array(
        msg(1, "system", F.col("system_prompt")), msg(2, "system", some(instruction_rules("system_prompt"))),
        msg(3, "system", F.when(F.col("compressed") != "", F.concat(F.lit(fixed.SUMMARY_HEADING), summary))),
        msg(4, "system", F.concat(F.lit(fixed.MEMORY_HEADING), some(F.col("memory_context")), F.lit(fixed.MEMORY_FOOTER))),
        msg(5, "system", F.lit(fixed.ATTENTION_GUIDANCE)), msg(6, "user", rag),
        msg(6, "assistant", F.when(rag.isNotNull(), F.lit(fixed.RAG_REPLY)))), lambda m: m["content"].isNotNull())
    opened = cut_lineage(head.join(fitted, "conv_id", "left").withColumn("_open", opening).withColumn(
        "opening_tokens", F.aggregate("_open", F.lit(3), lambda acc, m: acc + 4 + token_count(m["content"]))).withColumn(
        "remaining", F.col("total_available") - F.col("opening_tokens")))

    limits = opened.filter("remaining > 0").select("conv_id", F.col("remaining").alias("token_budget"), F.col("recap").alias("recap_budget"))
    n_chunks = chunks.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    kept = cut_lineage(fit_history(history, limits, n_chunks, messages_per_chunk))
    split = cut_lineage(relevance_split(kept, current))
    guard = cut_lineage(repetition_guard(history, current, threshold).join(limits.select("conv_id"), "conv_id", "left_semi"))
    recaps = cut_lineage(fitted_recap(kept, limits))

    shape = ["conv_id", "section", "sub", "role", "content"]
    parts = [
        opened.select("conv_id", F.posexplode("_open").alias("sub", "m")).select("conv_id", "m.section", F.col("sub").cast("long").alias("sub"), "m.role", "m.content"),
        split.select("conv_id", F.when(F.col("section") == "key", 7).otherwise(8).alias("section"), F.col("turn").cast("long").alias("sub"), "role", F.col("text").alias("content")),
        guard.select("conv_id", F.lit(9).alias("section"), F.posexplode(F.array("hint", F.lit(fixed.ANTI_REPETITION))).alias("sub", "content")).select(
            "conv_id", "section", F.col("sub").cast("long").alias("sub"), F.lit("system").alias("role"), "content"),
        recaps.filter("recap <> ''").select("conv_id", F.lit(10).alias("section"), F.lit(0).cast("long").alias("sub"), F.lit("system").alias("role"), F.col("recap").alias("content")),
        current.select("conv_id", F.lit(11).alias("section"), F.lit(0).cast("long").alias("sub"), F.lit("user").alias("role"), F.col("message").alias("content")),
    ]
    rows = parts[0].select(*shape)
    for p in parts[1:]:
        rows = rows.unionByName(p.select(*shape))
    # one integer position per row, in list order; sections are at most 2^40 rows long
    placed = rows.select("conv_id", (F.col("section").cast("long") * (1 << 40) + F.col("sub")).alias("turn"),
                         "section", "role", F.col("content").alias("text"))
    first = cut_lineage(placed.withColumn("turn", F.when(F.col("section") == 1, 0).otherwise(F.col("turn"))))
    budget = requests.select("conv_id", context_budget(F.lit(context_size), F.lit(reserve)).alias("budget"))
    final = trim_messages(first, budget, block=1 << 40).select("conv_id", F.col("turn").alias("pos"), "section", "role", F.col("text").alias("content"))

    kept_tokens = split.groupBy("conv_id").agg(F.sum(F.lit(4) + token_count("text")).alias("_h"),
                                               F.bool_or("was_compressed").alias("_wc"),
                                               F.countDistinct("section").alias("_lists"))
    meta = (opened.join(sizes.select("conv_id", "current_tokens", "n_messages"), "conv_id").join(kept_tokens, "conv_id", "left").join(n_chunks, "conv_id", "left")
            .join(recaps.select("conv_id", (F.col("recap") != "").alias("_rc")), "conv_id", "left")
            .join(guard.select("conv_id", F.lit(True).alias("_g")), "conv_id", "left"))
    history_tokens = F.when(F.col("remaining") > 0, F.coalesce("_h", F.lit(0)) + 6).otherwise(0)
    off = F.lit(False)
    return final, meta.select(
        "conv_id", F.lit(context_size).alias("context_size"), F.col("opening_tokens").alias("system_tokens"),
        history_tokens.cast("long").alias("history_tokens"), "current_tokens",
        (F.col("opening_tokens") + history_tokens + F.col("current_tokens")).cast("long").alias("total_tokens"),
        F.coalesce("_wc", (F.col("remaining") > 0) & (F.col("n_messages") > 0)).alias("was_compressed"), F.coalesce("_rc", off).alias("has_recap"),
        F.when(F.col("remaining") > 0, F.col("turns")).otherwise(0).alias("turn_count"),
        F.coalesce("n_chunks", F.lit(0)).alias("hierarchical_chunks"), F.coalesce("_g", off).alias("dedup_triggered"),
        F.round("depth_factor", 6).alias("depth_factor"))


# --- stored history ----------------------------------------------------------------------------------

def list_sessions(sessions: DataFrame, hidden_prefix: str = "search_") -> DataFrame:
    return sessions.filter(~F.col("id").startswith(hidden_prefix)).orderBy(F.col("updated_at").desc())


SOURCES = "array<struct<doc_id:string,pages:string>>"


def session_messages(history: DataFrame) -> DataFrame:
    """Stored messages with epoch milliseconds and parsed sources, in (created_at, id) order per session."""
    return history.select(
        "session_id", "id", "role", "content", F.coalesce(F.unix_millis("created_at"), F.lit(0)).alias("timestamp"),
        F.coalesce(F.from_json("sources", SOURCES), F.array().cast(SOURCES)).alias("sources")).orderBy("session_id", "timestamp", "id")


def last_n_history(messages: DataFrame, n: int = 20) -> DataFrame:
    """Last n messages per conversation as ``role: content`` lines."""
    last = top_k(messages, ["conv_id"], [F.col("turn").desc()], n, "_rn")
    return last.groupBy("conv_id").agg(joined("\n", F.concat("role", F.lit(": "), "text"), "turn").alias("history"))
