"""Word lists and thresholds that diagnoses rest on."""

from __future__ import annotations

# English terms by tier, hedges and transitions.
T1_EN = [
    "delve", "delves", "delved", "delving", "delve into", "delves into", "delved into", "delving into", "tapestry", "testament", "underscore",
    "underscores", "underscoring", "underscored", "pivotal", "showcase", "showcases", "showcasing", "showcased", "boasts", "meticulous",
    "meticulously", "intricate", "intricacies", "vibrant", "bolster", "bolstered", "garner", "garnered", "interplay", "realm", "myriad",
    "paradigm shift", "groundbreaking", "indelible", "unwavering", "profound implications", "ever-evolving", "at the forefront",
    "plays a crucial role", "plays a vital role", "plays a pivotal role", "is a testament to", "stands as a testament", "navigating the complexities",
    "in today's fast-paced",
]
T2_EN = [
    "crucial", "enduring", "leverage", "leveraging", "robust", "nuanced", "comprehensive", "novel", "paramount", "facilitate", "facilitates",
    "utilize", "utilizes", "utilized", "utilizing", "utilization", "demonstrate", "demonstrates", "significantly", "effectively", "enhance",
    "enhances", "enhancing", "foster", "fosters", "fostering", "align with", "aligns with", "aligned with", "highlight", "highlights", "highlighting",
    "emphasize", "emphasizes", "emphasizing", "landscape", "valuable insights", "additionally", "furthermore", "moreover", "notably", "consequently",
    "in conclusion", "overall", "it is worth noting", "it is important to note", "it should be emphasized", "it could be argued that",
]
T3_EN = [
    "however", "therefore", "thus", "hence", "while", "although", "various", "numerous", "several", "key", "essential", "significant", "approach",
    "framework", "mechanism", "perspective", "dimension",
]
HEDGES_EN = [
    "arguably", "to some extent", "may suggest", "might suggest", "could potentially", "it is possible that", "relatively", "somewhat",
    "generally speaking", "in some cases", "to a certain degree", "appears to", "seems to", "tends to",
]
TRANSITIONS_EN = [
    "additionally", "furthermore", "moreover", "however", "therefore", "consequently", "notably", "in conclusion", "overall", "firstly", "secondly",
    "finally", "in addition", "thus", "hence",
]

# Chinese terms by tier, and hedges.
T1_ZH = [
    "具有重要意义", "具有重要价值", "具有重要作用", "具有深远影响", "深远影响", "重要意义", "开启新篇章", "开辟新篇章", "奠定了坚实基础", "奠定坚实基础", "标志着", "彰显了", "彰显出", "凸显了", "折射出", "综上所述", "总而言之",
    "概括来说", "由此可见", "不言而喻", "机遇与挑战并存", "未来可期", "前景广阔", "前景值得期待", "指明了方向", "提供了有益借鉴", "提供了宝贵经验", "提供了重要参考", "提供了新思路", "至关重要", "不可或缺", "不可替代", "极其重要",
    "革命性", "颠覆性", "淋漓尽致", "卓有成效", "行之有效", "堪称典范", "赋能", "护航", "保驾护航", "全方位", "全链路", "全生命周期", "闭环", "抓手", "底层逻辑", "价值沉淀", "长期主义", "深度融合", "颗粒度", "场景化",
    "跃迁", "生态化", "深刻揭示了", "充分体现了", "充分说明了", "有力证明了", "生动诠释了",
]
T2_ZH = [
    "深入探讨", "深入分析", "深入研究", "全面分析", "系统梳理", "综合运用", "充分体现", "充分说明", "有效解决", "有效提升", "显著提升", "大幅提升", "提供了理论支撑", "完善了理论体系", "丰富了理论内涵", "值得注意的是",
    "需要指出的是", "不可否认", "众所周知", "毋庸置疑", "在这一背景下", "在此背景下", "随着的不断", "与此同时", "更有甚者", "揭示了", "阐明了", "印证了", "反映出", "体现出", "呈现出", "可视为", "打造", "构建起", "助力",
    "赋予", "催生", "广受关注", "引发热议", "备受瞩目", "业内好评", "总体而言", "从这个角度来看", "归根结底", "本质上", "核心在于", "真正的问题在于", "让我们深入", "本文将带你",
]
T3_ZH = [
    "此外", "然而", "因此", "同时", "进一步", "从而", "基于此", "鉴于此", "涵盖", "涉及", "囊括", "具备", "剖析", "探寻", "探索", "评估", "促使", "推动", "优化", "实现", "提升", "解决", "缓解", "融合",
    "格局", "维度", "层面", "视角", "路径", "机制", "范式",
]
HEDGES_ZH = [
    "似乎", "可能", "或许", "大概", "在一定程度上", "某种程度上", "潜在", "一定的", "相对而言", "总体上",
]

# Weights by tier, and hits of T1 and T2 that a paragraph may have.
WEIGHTS = {"T1": 3.0, "T2": 1.5, "T3": 0.3}
PARAGRAPH_LIMIT = 2

# Metric, side it is judged on, human bound, model bound, whether it is calibrated.
THRESHOLDS_EN = [
    ("passive_ratio", "high", 0.30, 0.45, False),
    ("hedge_density", "high", 0.03, 0.06, False),
    ("ttr", "low", 0.72, 0.60, False),
    ("transition_density", "high", 0.02, 0.04, False),
    ("sent_len_cv", "low", 0.25, 0.15, False),
    ("digit_density", "low", 1.2, 0.4, True),
]
THRESHOLDS_ZH = [
    ("sent_len_cv", "low", 0.25, 0.15, False),
    ("connective_ratio", "high", 0.08, 0.12, False),
    ("content_ratio", "low", 0.55, 0.45, False),
    ("digit_density", "low", 1.79, 0.63, True),
    ("proper_density", "low", 1.0, 0.3, False),
    ("ttr", "low", 0.60, 0.50, False),
    ("ngram_repeat", "high", 0.03, 0.06, False),
]


def terms(lang: str) -> list[tuple[str, str, float]]:
    """(term, tier, weight) of a language, longest first."""
    tiers = {"en": (T1_EN, T2_EN, T3_EN), "zh": (T1_ZH, T2_ZH, T3_ZH)}[lang]
    out = [(t, name, WEIGHTS[name]) for name, own in zip(("T1", "T2", "T3"), tiers, strict=True) for t in own]
    return sorted(out, key=lambda x: (-len(x[0]), x[0]))
