"""Classes of words and phrases whose number a rewrite must keep, by language, and how bounds are written."""

from __future__ import annotations

# Chinese classes.
ZH = {
    "negation": (
        r"并非|没有|尚无|无法|不得|不能|不会|不应|不可|未见|未观察到|未检出|未证实|未(?!来)[\u4e00-\u9fff]{1,5}|缺乏|尚缺|不足以|不具备|否认|排除(?!无论|疑问)"
        r"|无(?:统计学|临床)?意义|无(?:显著|明显|直接|足够|充分|证据|差异|改善|变化|影响|关联|关系|效应|作用|结果|数据|支持)|无(?!锡|论|疑|穷|聊|辜|畏|暇)[\u4e00-\u9fff]{1,5}"
        r"|不对[^\n，。！？]{0,8}(?:开放|公开)|不代表|不意味着|未(?:经|能|完成|确认|发现|达到|提供|开始|决定|授权)|不(?!仅|断|懈|禁|妨|时|日|由|啻|愧|惜|错|凡|料)[\u4e00-\u9fff]{1,4}"
    ),
    "uncertainty": r"可能|也许|或许|似乎|大概|据称|尚未确认|原因不明",
    "planned": r"计划|预计|拟于|将于|尚未开始|暂定",
    "ongoing": r"正在|仍在|还在|尚在",
    "done": r"已经|已完成|已通过|已发布|已确认",
    "condition": r"只有|除非|如果|若是|若[^\n，。！？]{0,12}(?:则|，)|在[^\n，。！？]{1,20}条件下",
    "scope": r"(?<!不)仅(?:限|适用|在|对|有|可|能)?|至少|至多|全部|所有|部分|多数|少数|始终|任何|均",
    "attribution": r"研究表明|实践表明|数据表明|数据显示|结果显示|证据显示|声称|据称|认为|表示|指出|报告|反映|表明|显示|发现",
    "up": r"增加|提高|上升|增长|增强|扩大|升高|变高",
    "down": r"减少|降低|下降|减弱|缩小|变低",
    "higher": r"高于|优于|多于|大于|超过",
    "lower": r"低于|劣于|少于|小于|不足",
    "relation": r"影响|促进|抑制|决定|包含|属于|依赖|作用于|导致|造成|引发|负责|用于|采用|处理|对应|承担|执行|生成|训练|部署",
}
# English classes.
EN = {
    "negation": (
        r"\b(?:never|neither|nor|without|cannot|can(?:not|['’]t)|(?:could|would|should|must|do|does|did|is|are|was|were|has|have|had)n['’]t|won['’]t|shan['’]t|fail(?:s|ed)?\s+to|lack(?:s|ed|ing)?)\b"
        r"|\bnot\b(?!\s+(?:only|just|merely|simply|more\s+than|less\s+than))|\bno\b(?!\s+(?:more|less)\s+than)"
    ),
    "uncertainty": r"\b(?:could\s+potentially|may\s+possibly|may|might|could|perhaps|possibly|probably|apparently|likely|unlikely|appears?(?:\s+to)?|seems?(?:\s+to)?|tends?(?:\s+to)?|suggests?)\b",
    "planned": r"\b(?:plans?|planned|planning|intends?|intended|intending|aims?|aimed|aiming|proposes?|proposed|proposing)\s+to\b|\b(?:is|are|was|were)\s+(?:scheduled|expected|projected)\s+to\b|\bwill\b",
    "ongoing": r"\b(?:currently|ongoing|underway|in\s+progress|continues?\s+to|(?:is|are|was|were)\s+being)\b",
    "done": r"\b(?:(?:has|have|had)\s+(?:been\s+)?|(?:is|are|was|were)\s+)?(?:completed|finished|released|published|confirmed|achieved|implemented)\b",
    "condition": r"\b(?:if|unless|provided\s+that|providing\s+that|as\s+long\s+as|only\s+if|in\s+the\s+event\s+that|subject\s+to)\b",
    "universal": r"\b(?:all|every|each|always)\b",
    "partial": r"\b(?:some|most|many|several|(?:a\s+)?few)\b",
    "any": r"\b(?:any|either)\b",
    "only": r"\b(?:only|solely|exclusively)\b(?!\s*[+\-−]?\d)",
    "obligation": r"\b(?:must|shall|required|mandatory)\b",
    "advice": r"\b(?:should|recommended|advisable)\b",
    "ability": r"\b(?:can|able\s+to|permitted\s+to|allowed\s+to)\b",
    "attribution": (
        r"\b(?:studies|research|data|evidence|results?)\s+(?:show|shows|showed|suggest|suggests|suggested|indicate|indicates|indicated|report|reports|reported|find|finds|found)\b"
        r"|\baccording\s+to\b|\b(?:was|were|is|are)\s+reported\b"
    ),
    "up": r"\b(?:increase[ds]?|increasing|rise[sn]?|rose|rising|grow(?:s|th|ing|n)?|improve[ds]?|improving|enhance[ds]?|enhancing)\b",
    "down": r"\b(?:decrease[ds]?|decreasing|decline[ds]?|declining|drop(?:s|ped|ping)?|reduce[ds]?|reducing|lower(?:s|ed|ing)?)\b",
    "higher": r"\b(?:higher|greater|more|above|superior|outperform(?:s|ed|ing)?|exceed(?:s|ed|ing)?)\b",
    "lower": r"\b(?:lower|less|fewer|below|inferior|underperform(?:s|ed|ing)?)\b",
    "equal": r"\b(?:equal|equals|equivalent|the\s+same\s+as)\b",
    "different": r"\b(?:different|differs?|distinct)\b",
    "relation": (
        r"\b(?:affect(?:s|ed|ing)?|influence(?:s|d|ing)?|determine(?:s|d|ing)?|include(?:s|d|ing)?|contain(?:s|ed|ing)?|depend(?:s|ed|ing)?\s+on"
        r"|cause(?:s|d|ing)?|lead(?:s|ing)?\s+to|led\s+to|result(?:s|ed|ing)?\s+in|promote(?:s|d|ing)?|inhibit(?:s|ed|ing)?)\b"
    ),
}
# Signs of bounds and the phrases for them that stand before a number.
BOUNDS = {
    ">=": ["至少", "不少于", "at least", "no less than", "greater than or equal to"],
    "<=": ["至多", "不超过", "at most", "no more than", "less than or equal to"],
    ">": ["超过", "高于", "大于", "more than", "greater than", "above", "over"],
    "<": ["低于", "小于", "less than", "fewer than", "below", "under"],
    "=": ["等于", "equal to", "exactly"],
    "~": ["大约", "约", "接近", "approximately", "about", "around", "roughly", "nearly"],
    "only:": ["仅", "只有", "only"],
}
# Comparisons and equations in signs, and verbs of going together and of causing.
COMPARATOR = r"(?:<=|>=|≤|≥|＜|＞|≦|≧|<|>)\s*(?:[+\-−]?\d+(?:[.,]\d+)*\s*%?|[A-Za-z][A-Za-z0-9_]*)"
EQUATION = r"\b[A-Za-z][A-Za-z0-9_]*\s*(?:=|≠|≈|≃|∝)\s*[A-Za-z0-9_+\-−*/^·⋅²³⁻¹]+"
TOGETHER = r"相关|关联|有关|同时出现|共变|(?i:\b(?:correlat(?:e[sd]?|ed|ing|ion)|associat(?:e[sd]?|ed|ing|ion)|relat(?:e[sd]?|ed|ing|ion)|link(?:s|ed|ing)?)\s+(?:with|to)\b)"
CAUSING = (
    r"导致|造成|引发|使得|因此产生|是[^\n，。]{0,15}的原因"
    r"|(?i:\b(?:cause(?:s|d|ing)?|lead(?:s|ing)?\s+to|led\s+to|result(?:s|ed|ing)?\s+in|bring(?:s|ing)?\s+about|brought\s+about|drive(?:s|n|ing)?|drove)\b)"
)
