"""Prompt texts, in our own words; each states what the reply must hold."""

from __future__ import annotations

SIGNAL_CATEGORIES = "speech_style, catchphrase, values, knowledge, emotion, relationships, signature_event, background, taboo, mannerism"
NER = "列出片段中出现的人物。只依据原文，evidence 必须逐字摘自片段，不超过 120 字。以 JSON 回复：{{\"mentions\": [{{\"name\", \"aliases\", \"category\": speech|appearance|event, \"evidence\", \"co_mentioned\", \"relation_to\"}}]}}\n\n片段：\n{text}"
EXTRACTOR = f"从语料片段中提取人格信号。类别：{SIGNAL_CATEGORIES}。每条给出 category、content、evidence、salience（0 到 1），并写 summary。"
EXTRACTOR_BATCH = (
    "下面是一个 JSON 数组，每个元素是一个文本片段：source、chunk_index、char_start、char_end、token_count、text。"
    f"对每个片段分别提取人格信号。类别：{SIGNAL_CATEGORIES}。每条给出 category、content、evidence（该片段 text 中的原文，不超过 80 字）、salience（0 到 1）；没有原文依据的不写。"
    "summary 不超过 120 字。以 JSON 回复：{\"items\": [{\"source_file\", \"chunk_index\", \"signals\", \"summary\"}]}，每个片段恰好一项，source_file 取其 source，不得遗漏。"
)
SYNTHESIZER = "合并同类信号；多个来源支持的信号 salience 加 0.1（至多 1）；舍去低于 {threshold} 的信号；每类保留 3 至 6 条。输出人格卡 JSON：persona_id、system_prompt、display_name、tags、expression_dna、mental_models、decision_heuristics、anti_patterns、honest_boundaries。persona_id 建议用 {persona_id}。"
SKILL_DESIGNER = "依据人格卡设计至多 {most} 个技能，JSON 列表 items：name、description、when_to_use、instructions；mental_models 只能取自人格卡。"
PRESET_DIALOGUES = "依据人格卡写至多 {most} 组预设对话，JSON 列表 items：user、assistant、intent。"
PROFILE = "用不超过 400 字概述人物。\n\n{facts}"
BRIDGE = "说明该人物重建语料的来源与取舍。"
CONDUCTOR = "依次：读入并切块、识别人物、建立索引、合并同名、选定人物、提取信号、提炼人格卡、设计技能与对话。工作目录：{workdir}"
OC = {
    "monologue.md": "以第一人称写一段独白。\n\n{setting}",
    "dialogue.md": "写该人物与他人的三段对话。\n\n{setting}",
    "event.md": "写该人物经历的三件事。\n\n{setting}",
    "memory.md": "写该人物的三段记忆。\n\n{setting}",
}
PLAYER = "你是这个人物，用其口吻回答。\n\n{setting}\n\n{skeleton}"
INTERVIEWER = "你在采访一个人物。根据已有问答提出下一个问题，只给问题。"


def synthesizer(threshold: float, persona_id: str) -> str:
    return SYNTHESIZER.format(threshold=threshold, persona_id=persona_id)


def skill_designer(most: int) -> str:
    return SKILL_DESIGNER.format(most=most)


def preset_dialogues(most: int) -> str:
    return PRESET_DIALOGUES.format(most=most)


def conductor(workdir: str = "") -> str:
    return CONDUCTOR.format(workdir=workdir)
