"""Entities by rules and dictionaries, from token labels, and their de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions.segments import bound, each, literal_starts, with_matches
from verdigris.operators import dictionary

# Rule patterns with type and score, dictionaries with score, and label types.
RULES = {
    "address_1": (r"(?:[一-鿿]{2,}(?:省|市|自治区|特别行政区|县|区|镇|乡|村|街道|路|街|道|巷|弄|号|楼|层|单元|室|座)){2,}", "ADDRESS", 0.9),
    "address_2": (r"[0-9]{6}[0-9A-Za-z一-鿿\-]+", "ADDRESS", 0.9),
    "phone": (r"(?:(?:\+?86)?[ -]?1[3-9][0-9]{9})|(?:[0-9]{3,4}[ -]?[0-9]{7,8})", "CONTACT", 0.95),
    "email": (r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", "CONTACT", 0.95),
    "date_1": (r"[0-9]{4}[年/\-][0-9]{1,2}[月/\-][0-9]{1,2}[日号]?", "DATE", 0.9),
    "date_2": (r"[0-9]{4}\.[0-9]{1,2}\.[0-9]{1,2}", "DATE", 0.9),
}
KEYWORDS = {
    "PROCESS": (0.75, ("工艺", "流程", "工序", "生产线", "加工", "处理", "净化", "过滤", "沉淀", "曝气", "厌氧", "好氧", "膜生物", "MBR", "反渗透", "离子交换", "活性炭", "吸附", "焚烧", "填埋", "堆肥", "热解", "气化", "脱硫", "脱硝", "除尘", "VOCs", "预处理", "生化处理", "深度处理", "污泥处置")),
    "PRODUCT": (0.75, ("产品", "制品", "材料", "试剂", "催化剂", "添加剂", "制剂", "涂料", "油墨", "胶粘剂", "清洗剂", "溶剂", "染料")),
    "MATERIAL": (0.75, ("原料", "原材料", "物料", "辅料", "化学品", "药剂", "树脂", "膜元件", "滤料", "填料", "催化剂")),
    "EMISSION": (0.85, ("COD", "BOD", "NH3", "氨氮", "总氮", "总磷", "SS", "悬浮物", "pH", "色度", "浊度", "重金属", "汞", "镉", "铅", "铬", "砷", "SO2", "NOx", "颗粒物", "PM2.5", "PM10", "VOCs", "排放浓度", "排放量", "排放限值", "排放标准")),
    "REGULATION": (0.80, ("标准", "规范", "条例", "法规", "办法", "GB", "HJ", "DB", "环评", "排污许可", "限期治理", "总量控制")),
}
LABEL_TYPES = {"PER": "PERSON", "PERSON": "PERSON", "ORG": "ORG", "ORGANIZATION": "ORG", "LOC": "LOC", "LOCATION": "LOC", "GPE": "GPE"}


#: Where a rule's match can begin if it begins at all, so that long runs are read once: a run's start, or the end of the match before.
_STARTS = {"address_1": r"(?:(?<![一-鿿])|\G)", "email": r"(?:(?<![A-Za-z0-9._%+\-])|\G)"}
#: What a text must hold for a rule to be tried.
_NEEDS = {"address_1": "[一-鿿]", "address_2": "[0-9]{6}", "phone": "[0-9]{5}", "email": "@", "date_1": "[0-9]{4}[年/\\-]", "date_2": r"[0-9]{4}\."}
ENTITY = "struct<type:string,text:string,start:int,end:int,score:double>"


def _entity(kind, text: Column, start: Column, end: Column, score) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(kind).alias("type"), text.alias("text"), start.cast("int").alias("start"), end.cast("int").alias("end"), lit(score).cast("double").alias("score"))


def with_rules(df: DataFrame, text: str = "text", rules: dict = RULES, out: str = "rule_entities") -> DataFrame:
    """df with a column of the matches of all rules, array<struct<type,text,start,end,score>>; addresses have six characters or more."""
    names = {f"_rule_{k}": k for k in rules}
    patterns = {n: _STARTS.get(k, "") + f"(?:{rules[k][0]})" for n, k in names.items()}
    found = with_matches(df, text, patterns, {n: F.col(text).rlike(_NEEDS[k]) for n, k in names.items() if k in _NEEDS})

    def typed(name: str) -> Column:
        _, kind, score = rules[names[name]]
        some = F.filter(name, lambda m: F.length(m["match"]) >= 6) if kind == "ADDRESS" else F.col(name)
        return F.transform(some, lambda m: _entity(kind, m["match"], m["start"], m["end"], score))

    each = F.concat(*[typed(n) for n in names]) if names else F.array().cast(f"array<{ENTITY}>")
    return found.select(*df.columns, each.alias(out))


def keyword_array(text: Column, keywords: dict = KEYWORDS, context: int = 0) -> Column:
    """Every occurrence of every keyword in a text, array<struct<type,text,start,end,score>>. context: up to so many Chinese characters on each side join the span."""
    words = [(t, w, s) for t, (s, ws) in keywords.items() for w in ws]
    if not words:
        return F.array().cast(f"array<{ENTITY}>")
    entries = F.array(*[F.struct(F.lit(t).alias("type"), F.lit(w).alias("word"), F.lit(s).cast("double").alias("score")) for t, w, s in words])

    def span(e: Column, at: Column) -> Column:
        n = F.length(e["word"])
        if not context:
            return _entity(e["type"], e["word"], at, at + n, e["score"])
        before = F.length(F.regexp_extract(F.substr(text, F.greatest(at - context + 1, F.lit(1)), F.least(at, F.lit(context))), r"[一-鿿㐀-䶿]*$", 0))
        after = F.length(F.regexp_extract(F.substr(text, at + n + 1, F.lit(context)), r"^[一-鿿㐀-䶿]*", 0))
        return _entity(e["type"], F.substr(text, at - before + 1, before + n + after), at - before, at + n + after, e["score"])

    some = F.filter(entries, lambda e: text.contains(e["word"]))
    return F.coalesce(F.flatten(F.transform(some, lambda e: F.transform(literal_starts(text, e["word"]), lambda at: span(e, at)))), F.array().cast(f"array<{ENTITY}>"))


#: Words from which on texts are read once by an automaton, and not once for each word.
MANY = 16


def with_keywords(df: DataFrame, text: str = "text", keywords: dict = KEYWORDS, context: int = 0, out: str = "keyword_entities") -> DataFrame:
    """df with a column of keyword_array, however many keywords there are."""
    entries: dict[str, list[tuple[int, str, float]]] = {}
    for n, (kind, score, w) in enumerate((t, s, w) for t, (s, ws) in keywords.items() for w in ws):
        entries.setdefault(w, []).append((n, kind, float(score)))
    if len(entries) < MANY:
        return df.withColumn(out, keyword_array(F.col(text), keywords, context))
    words = sorted(entries)

    def make(automaton: dictionary.Automaton, t: str | None) -> list[dict]:
        found = []
        for i, start in automaton.starts(t or ""):
            word, low, high = words[i], start, start + len(words[i])
            while context and low > 0 and start - low < context and _is_han(t[low - 1]):
                low -= 1
            while context and high < len(t) and high - start - len(word) < context and _is_han(t[high]):
                high += 1
            found += [(n, start, {"type": kind, "text": t[low:high], "start": low, "end": high, "score": score}) for n, kind, score in entries[word]]
        return [e for _, _, e in sorted(found, key=lambda x: x[:2])]

    return dictionary.mapped(df, text, words, out, f"array<{ENTITY}>", make)


def _is_han(c: str) -> bool:
    return "一" <= c <= "鿿" or "㐀" <= c <= "䶿"


def _exploded(df: DataFrame, key: str, entities: Column) -> DataFrame:
    return each(df, [key], entities, "_e").select(key, "_e.*")


def rule_entities(df: DataFrame, key: str, text: str = "text", rules: dict = RULES) -> DataFrame:
    """key, type, text, start, end, score of every match of the rules; addresses have six characters or more."""
    return _exploded(with_rules(df.select(key, text), text, rules, "_found"), key, F.col("_found"))


def keyword_entities(df: DataFrame, key: str, text: str = "text", keywords: dict = KEYWORDS, context: int = 0) -> DataFrame:
    """key, type, text, start, end, score of every occurrence of every keyword."""
    return _exploded(with_keywords(df.select(key, text), text, keywords, context, "_found"), key, F.col("_found"))


def _greedy(touching: Column) -> Column:
    """Of entities that touch each other, those that stay: best score first, earlier first on ties."""
    none = F.array().cast(f"array<{ENTITY}>")
    ranked = F.transform(F.array_sort(F.transform(touching, lambda e: F.struct((-e["score"]).alias("s"), e["start"].alias("at"), e.alias("e")))), lambda x: x["e"])
    same = lambda e, k: (e["type"] == k["type"]) & (e["text"] == k["text"])
    return F.aggregate(ranked, none, lambda a, e: F.when(F.exists(a, lambda k: same(e, k) & (e["start"] <= k["end"]) & (e["end"] >= k["start"])), a).otherwise(F.concat(a, F.array(e))))


def dedup_array(entities: Column) -> Column:
    """The entities of one text without those that overlap or touch a kept one of their type and text, in order.

    Spans of one text have one length, so only neighbours in the order of type, text and start can touch; what touches nothing stays
    without a further look.
    """

    def sorted_(a: Column) -> Column:
        meets = lambda i: (F.get(a, i - 1)["type"] == F.get(a, i)["type"]) & (F.get(a, i - 1)["text"] == F.get(a, i)["text"]) & (F.get(a, i)["start"] <= F.get(a, i - 1)["end"])
        touches = lambda i: F.coalesce(meets(i), F.lit(False)) | F.coalesce(meets(i + 1), F.lit(False))
        alone, together = F.filter(a, lambda _, i: ~touches(i)), F.filter(a, lambda _, i: touches(i))
        return F.concat(alone, F.when(F.size(together) > 0, _greedy(together)).otherwise(F.array().cast(f"array<{ENTITY}>")))

    kept = bound(F.array_sort(entities), sorted_)
    return F.transform(F.array_sort(F.transform(kept, lambda e: F.struct(e["start"].alias("at"), e.alias("e")))), lambda x: x["e"])


def dedup_entities(entities: DataFrame, key: str) -> DataFrame:
    """Of entities of one key, type and text that overlap or touch, those with the best scores (earlier first on ties); the order is greedy, not transitive.

    A window over the mentions of one key, type and text finds clusters of touching ones; only a cluster is gathered.
    """
    w = Window.partitionBy(key, "type", "text").orderBy("start", "end")
    so_far = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = entities.select(key, "type", "text", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.col("score").cast("double").alias("score"))
    marked = new.withColumn("_new", F.coalesce((F.col("start") > so_far).cast("int"), F.lit(1))).withColumn("_c", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    groups = marked.groupBy(key, "type", "text", "_c").agg(F.collect_list(F.struct("type", "text", "start", "end", "score")).alias("_all"))
    kept = F.when(F.size("_all") > 1, _greedy(F.col("_all"))).otherwise(F.col("_all"))
    return _exploded(groups.select(key, kept.alias("_kept")), key, F.col("_kept"))


def bio_entities(tokens: DataFrame, key: str) -> DataFrame:
    """Entities of labelled tokens (key, pos, word, label, score, start): B- opens, I- and ## pieces extend, anything else closes; unknown types are dropped."""
    w = Window.partitionBy(key).orderBy("pos")
    piece = F.col("word").startswith("##")
    begins = F.col("label").startswith("B-") & ~piece
    closes = ~begins & ~F.col("label").startswith("I-") & ~piece
    island = tokens.withColumn("_i", F.count_if(begins | closes).over(w)).withColumn("_closed", closes)
    head = Window.partitionBy(key, "_i").orderBy("pos")
    held = island.withColumn("_first", F.first("label").over(head)).filter(F.col("_first").startswith("B-"))
    types = F.create_map(*[F.lit(x) for kv in LABEL_TYPES.items() for x in kv])
    g = held.groupBy(key, "_i", "_first").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.regexp_replace("word", "^##", "").alias("word")))), lambda x: x["word"]), "").alias("text"),
        F.min("start").alias("start"), F.round(F.avg("score"), 4).alias("score"),
    )
    kind = types[F.regexp_replace("_first", "^B-", "")]
    return g.select(key, kind.alias("type"), "text", "start", (F.col("start") + F.length("text")).alias("end"), "score").filter("type is not null")


def with_entities(df: DataFrame, text: str = "text", keywords: dict = KEYWORDS, out: str = "entities") -> DataFrame:
    """df with a column of the de-duplicated rule and keyword entities of each text, in order; found within the row, nothing is shuffled."""
    ruled = with_rules(df, text, out="_ruled")
    ruled = with_keywords(ruled, text, keywords, out="_worded")
    found = F.when(F.trim(F.coalesce(F.col(text), F.lit(""))) != "", F.concat("_ruled", "_worded"))
    both = ruled.withColumn("_found", F.coalesce(found, F.array().cast(f"array<{ENTITY}>")))
    return both.select(*df.columns, F.when(F.size("_found") > 0, dedup_array(F.col("_found"))).otherwise(F.col("_found")).alias(out))


def extract_entities(df: DataFrame, key: str, text: str = "text", keywords: dict = KEYWORDS, tokens: DataFrame | None = None) -> DataFrame:
    """Entities of all kinds of each text, de-duplicated; blank texts have none."""
    if tokens is None:
        return _exploded(with_entities(df.select(key, text), text, keywords, "_found"), key, F.col("_found"))
    some = df.filter(F.trim(F.coalesce(F.col(text), F.lit(""))) != "")
    both = rule_entities(some, key, text).unionByName(keyword_entities(some, key, text, keywords)).unionByName(bio_entities(tokens, key))
    return dedup_entities(both, key)


def entity_counts(entities: DataFrame, key: str) -> DataFrame:
    return entities.groupBy(key, "type").agg(F.count("*").alias("n"))
