"""Settings of the programs from a file, and their log.

The file has sections of settings, as JSON, or as YAML where that library is installed. Programs take from it what their options don't say.
"""

from __future__ import annotations

import copy
import json
import logging
import logging.config
from pathlib import Path

#: Where a section's setting is the default of an option: (section, setting) of each option.
OPTIONS = {
    "n": ("generation", "num_probes"),
    "budget": ("budget", "max_tokens_per_probe"),
    "tokenizer": ("tokenizer", "path"),
    "folder": ("data", "dir"),
}


def read(path: str | None) -> dict:
    """The settings of a file; none without one. ValueError where they aren't sections."""
    if not path:
        return {}
    text = Path(path).read_text(encoding="utf-8")
    try:
        found = json.loads(text)
    except json.JSONDecodeError:
        try:
            import yaml
        except ImportError:
            raise ValueError(f"{path} isn't JSON, and YAML can't be read here") from None
        found = yaml.safe_load(text)
    if not isinstance(found, dict) or not all(isinstance(x, dict) for x in found.values()):
        raise ValueError(f"{path} has no sections")
    return found


def options(settings: dict) -> dict:
    """Values of the options that the settings name."""
    return {name: settings[section][key] for name, (section, key) in OPTIONS.items() if key in settings.get(section, {})}


def logger(settings: dict, name: str = "siftwork") -> logging.Logger:
    """The log that section logger_config describes, its file in the data folder; without one, lines on the console."""
    described = copy.deepcopy(settings.get("logger_config"))
    if not described:
        logging.basicConfig(format="%(asctime)s - %(levelname)s - %(message)s", level=logging.INFO)
        return logging.getLogger(name)
    folder = Path(settings.get("data", {}).get("dir", "."))
    for handler in described.get("handlers", {}).values():
        if "filename" in handler:
            folder.mkdir(parents=True, exist_ok=True)
            handler["filename"] = str(folder / handler["filename"])
    logging.config.dictConfig({"version": 1, "disable_existing_loggers": False, **described})
    return logging.getLogger(name)
