"""Patterns of clauses, their pieces, and the words that a clause's profile looks for."""

from __future__ import annotations

#: Where a clause ends: either language's marks, a line feed, and a full stop before white space.
CLAUSE_END = r"[，；。！？\n]|[,;!?]|\.(?=\s|$)"
#: A clause cut into numbers, single Han characters, words and whatever stands between; pieces concatenate to the clause.
PIECE = r"\d+(?:[.,]\d+)*|[\x{4e00}-\x{9fff}]|[^\P{L}\x{4e00}-\x{9fff}][^\P{L}\x{4e00}-\x{9fff}\d]*(?:[_-]?(?:[^\P{L}\x{4e00}-\x{9fff}]|\d)+)*|(?:[^\p{L}\d])+"
CITATION = r"[\[【]\s*\d+(?:\s*[-–,，]\s*\d+)*\s*[\]】]|[(（][^)）]{0,40}?(?:19|20)\d{2}[^)）]{0,10}[)）]|[A-Z][A-Za-z\-']+\s+et\s+al\.?"

# Words that may stand before a one-letter label, before "group", and characters that number things.
LABEL_BEFORE = ["model", "method", "variable", "sample", "group", "dataset", "phase", "version"]
GROUP_BEFORE = ["control", "treatment", "training", "validation", "test"]
LABEL = r"^[A-Z甲乙丙丁戊己庚辛壬癸]$"
#: Characters that may lie between a label and the number it is bound to.
LABEL_REACH = 24
# What acts on what.
ACTS_EN = r"(affect(?:s|ed)?|influence(?:s|d)?|determine(?:s|d)?|include(?:s|d)?|contain(?:s|ed)?|cause(?:s|d)?|promote(?:s|d)?|inhibit(?:s|ed)?)"
ACTS_ZH = r"(影响|促进|抑制|决定|包含|依赖|作用于|导致|造成|引发|负责|用于|采用|处理|对应|承担|执行|生成|训练|部署)"
#: Verbs that count as one.
SAME_ACT = {"^(?:affect|influence).*": "affect", "^cause.*": "cause", "^(?:include|contain).*": "include"}

# English words that are no content of a clause.
STOP = (
    "value importance significance impact aspect issue level ability effect basis condition factor feature advantage trend content result process method research "
    "analysis work field background angle dimension prospect challenge approach study paper section system model performance which that these those there their where "
    "while been being have has had with from this also more most such than then they them when what into over under between through across within both the and but for "
    "our its his her was were are however therefore although studies results abstract despite overall conclusion moreover furthermore additionally notably first firstly "
    "second secondly finally thus hence a an of to in on at as by or is be do does did will may might could"
).split()
