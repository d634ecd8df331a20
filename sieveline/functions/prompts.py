"""Prompts of language-model clients, filled in as columns. The texts are parameters; these are short ones of our own."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

VERDICTS = "Answer with JSON: verdict (real, fake or uncertain), confidence from 0 to 1, rationale."
SYSTEM = f"You judge whether an image is a real photograph, or made or changed by a machine. Look first, then use tools; a tool without findings proves nothing. {VERDICTS}"
VISION_SYSTEM = "You describe images for an examiner: what is shown, and what looks unnatural. You give no verdict on people."
VISION_USER = "Describe this image, then its anatomy, textures, light and writing, and say what is out of place. End with a verdict and a confidence."
AGENT = "Description of the image:\n{summary}\n\nFile for the tools: {path}\n\nUse the tools that may settle what is open. " + VERDICTS
RETRY = "Your last answer was no valid JSON:\n{previous}\n\nThe description was:\n{summary}\n\n" + VERDICTS


def filled(template: str, **values: Column) -> Column:
    """A template with each {name} replaced by a column; null counts as empty, and what a value holds is never read as a name."""
    parts = re.split(r"\{(\w+)\}", template)
    missing = set(parts[1::2]) - set(values)
    if missing:
        raise ValueError(f"no value for {sorted(missing)}")
    return F.concat(*(F.coalesce(values[part].cast("string"), F.lit("")) if i % 2 else F.lit(part) for i, part in enumerate(parts)))


def agent_prompt(summary: Column, path: Column) -> Column:
    return filled(AGENT, summary=summary, path=path)


def retry_prompt(summary: Column, previous: Column) -> Column:
    return filled(RETRY, summary=summary, previous=previous)
