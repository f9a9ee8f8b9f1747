"""Prompt strings for question answering and for canvas decisions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestore.functions.text import filled, format_choices


def lines(*parts: Column | str) -> Column:
    """Parts that are there, a line each."""
    return F.array_join(F.array_compact(F.array(*[F.lit(p) if isinstance(p, str) else p for p in parts])), "\n")


def labelled(name: str, c: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), filled(c))


def query_text(question: Column, hint: Column) -> Column:
    return F.trim(F.concat(question, F.lit(" "), F.coalesce(hint, F.lit(""))))


def memory_text(*parts: Column, choices: Column | None = None) -> Column:
    """Non-empty parts and the choices, separated by blanks."""
    more = [] if choices is None else [filled(F.array_join(choices, " "))]
    return F.concat_ws(" ", *[filled(p) for p in parts], *more)


# Prompt texts, which models are sensitive to.
TEMPLATES = {
    "science": """Study the reference canvases above. Each shows a solved example.
{hint}

Question: {question}
{choices}
Think step by step, then answer with just the letter:""",
    "visual": """Study the reference canvases. Answer the question about the last image.
Question: {question}
Answer concisely:""",
    "documents_with_memory": """Below are memory canvases from similar questions. Study them.
---
{context}
Question: {question}
Answer concisely:""",
    "documents": """{context}
Question: {question}
Answer concisely:""",
    "multi_hop": """{memory_instruction}

Now answer the following new question using the context below.

{context}

Question: {question}
Answer concisely:""",
}
# Further prompt texts, which models are sensitive to.
MULTI_HOP_INSTRUCTION = "Below are memory canvases from previously solved similar questions. Each canvas shows: relevant context passages, the question, and the correct answer (marked with ✓). Study these canvases carefully."
QA_HEAD = "The image above shows reference material (background knowledge, context, and/or figures). Use ONLY the information in the image to answer the following question."
QA_END = "Answer with ONLY the letter (A, B, C, etc.)."
TASK = "Answer the following question by selecting the correct option."
LETTER = "Answer with just the letter (A, B, C, D, etc.):"
REASON = "Think step by step, then give your final answer as a single letter (A, B, C, D, etc.) on the last line."
GUIDE = ("Below are memory canvas images from similar problems you solved before.", "Each canvas contains: the original question, answer choices (correct answer marked with ✓), background knowledge, and solution reasoning.")
SYSTEM = "You are a knowledgeable student who learns from past examples. When given reference canvases from similar problems, carefully study the solutions and background knowledge shown in them, then apply that knowledge to solve new problems."
#: For each variant: what comes before the memories, how a memory is announced, the last line, the system prompt.
VARIANTS = (
    (("Below are reference examples shown as images:",), "Reference {}", LETTER, None),
    ((*GUIDE, "Study these canvases and use the knowledge to help answer the new question.", ""), "[Canvas {}]", LETTER, None),
    ((*GUIDE, "Study these canvases carefully and apply the relevant knowledge to the new question.", ""), "[Canvas {}]", REASON, None),
    ((*GUIDE, "Study these canvases carefully and apply the relevant knowledge to the new question.", ""), "[Canvas {}]", REASON, SYSTEM),
)
#: Choices that have a letter in these prompts.
MOST_CHOICES = 6


def fill(template: str, **values: Column) -> Column:
    """A template with its names replaced, an absent value by nothing."""
    out = F.lit(TEMPLATES[template])
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def qa_prompt(question: Column, choices: Column) -> Column:
    listed = F.array_join(F.transform(choices, lambda c, i: F.concat(F.lit("  "), F.char(F.lit(65) + i), F.lit(". "), c, F.lit("\n"))), "")
    return F.concat(F.lit(QA_HEAD + "\n\nQ: "), question, F.lit("\n"), listed, F.lit("\n" + QA_END))


def variant(n: int, question: Column, choices: Column, hint: Column, memories: Column) -> Column:
    """system and user prompt of a variant; memories is an array of structs with subject and topic."""
    intro, mark, end, system = VARIANTS[n]
    before, after = mark.split("{}")
    shown = F.transform(memories, lambda m, i: F.concat(F.lit(before), (i + 1).cast("string"), F.lit(after + " ("), m["subject"], F.lit(" - "), m["topic"], F.lit(")")))
    top = F.when(F.size(memories) > 0, F.array_join(F.concat(F.array(*[F.lit(x) for x in intro]), shown, F.array(F.lit(""), F.lit("---"))), "\n"))
    options = F.concat(F.lit("Options:\n"), format_choices(choices, most=MOST_CHOICES))
    return F.struct(F.lit(system).cast("string").alias("system"), lines(top, TASK, labelled("Context", hint), F.concat(F.lit("Question: "), question), options, end).alias("user"))


def context(paragraphs: Column, most: int = 500) -> Column:
    """`[title]`, then the start of the text, paragraphs apart by a blank line."""
    return F.array_join(F.transform(paragraphs, lambda p: F.concat(F.lit("["), p["title"], F.lit("]\n"), F.substring(p["text"], 1, most))), "\n\n")


def zip_paragraphs(titles: Column, sentences: Column) -> Column:
    """Paragraphs from titles and sentence lists, as many as the shorter of the two."""
    n = F.least(F.size(titles), F.size(sentences))
    z = F.arrays_zip(F.slice(titles, 1, n).alias("t"), F.slice(sentences, 1, n).alias("s"))
    return F.transform(z, lambda x: F.struct(x["t"].alias("title"), F.array_join(x["s"], " ").alias("text")))


def supporting(paragraphs: Column, titles: Column, most: int = 300) -> Column:
    """Paragraphs with a wanted title, long texts cut with `...`."""
    cut = lambda t: F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("..."))).otherwise(t)
    return F.transform(F.filter(paragraphs, lambda p: F.array_contains(titles, p["title"])), lambda p: F.struct(p["title"].alias("title"), cut(p["text"]).alias("text")))


def canvas_line(canvas_id: Column, topic: Column, items: Column, patches: Column, most: Column, summary: Column) -> Column:
    share = F.round(100.0 * patches / most, 0).cast("int")
    return F.concat(F.lit("["), canvas_id, F.lit("] "), topic, F.lit(" ("), items.cast("string"), F.lit(" items, "), share.cast("string"), F.lit("% full): "), summary)


# What the agent is asked when it writes, reads and lays out.
EMPTY_LIBRARY = "(empty — no canvases yet)"
WRITE = "<canvas_library>\n{library}\n</canvas_library>\n\n<new_knowledge>\n{knowledge}\n</new_knowledge>\n\nDecide how to store this knowledge."
READ = "<question>{question}</question>\n\n<candidates>\n{candidates}\n</candidates>\n\nWhich canvases should be retrieved to answer the question?"
LAYOUT_HEAD = "You are a canvas layout agent. Given content blocks, output the optimal layout as JSON.\n\nContent blocks:"
LAYOUT_END = "\nAvailable strategies: {strategies}\nOutput JSON with keys: strategy, width_class(narrow/medium/wide), image_scale(small/medium/large), content_priority(question_first/context_first/balanced), truncation(none/light/heavy), font_profile(compact/normal/large)"


def _filled(template: str, **parts: Column) -> Column:
    """The template with its fields; a field's text is not looked at for further fields."""
    out, rest = [], template
    for name, c in parts.items():
        before, rest = rest.split("{" + name + "}", 1)
        out += [F.lit(before), c]
    return F.concat(*out, F.lit(rest))


def write_prompt(library: Column, knowledge: Column) -> Column:
    """library: a display line for each canvas."""
    shown = F.when(F.size(library) > 0, F.array_join(library, "\n")).otherwise(F.lit(EMPTY_LIBRARY))
    return _filled(WRITE, library=shown, knowledge=knowledge)


def read_prompt(question: Column, candidates: Column) -> Column:
    """candidates: structs of canvas_id, topic, score and summary."""
    line = lambda c: F.concat(F.lit("[Canvas #"), c["canvas_id"], F.lit('] Topic: "'), c["topic"], F.lit('" | Similarity: '), F.format_string("%.2f", c["score"] + F.lit(0.0)), F.lit("\n  Summary: "), F.coalesce(F.substring(filled(c["summary"]), 1, 200), F.lit("No summary")))
    return _filled(READ, question=question, candidates=F.array_join(F.transform(candidates, line), "\n"))


def layout_prompt(blocks: Column) -> Column:
    """blocks as the layout operators take them."""
    from lodestore.functions.jsonx import STRATEGIES

    number = lambda i: F.concat(F.lit("  #"), i.cast("string"))
    text = lambda b, i: F.concat(number(i), F.lit(" [text/"), b["role"], F.lit("] "), F.length(b["text"]).cast("string"), F.lit(" chars, font="), b["font"].cast("string"))
    image = lambda b, i: F.concat(number(i), F.lit(" [image/"), b["role"], F.lit("] "), b["w"].cast("string"), F.lit("x"), b["h"].cast("string"), F.lit(", ar="), F.format_string("%.2f", b["w"] / F.greatest(b["h"], F.lit(1))))
    lines = F.array_join(F.transform(blocks, lambda b, i: F.when(b["type"] == "image", image(b, i)).otherwise(text(b, i))), "\n")
    return F.concat(F.lit(LAYOUT_HEAD + "\n"), lines, F.lit("\n" + LAYOUT_END.replace("{strategies}", ", ".join(STRATEGIES))))
