"""Where transcripts and the store are, unless the caller says so: from the environment, else below the home folder."""

from __future__ import annotations

import os
from collections.abc import Mapping

PROJECTS_SETTING, STORE_SETTING = "LAKELOOM_PROJECTS", "LAKELOOM_STORE"
# Fixed value of the format: where its transcripts lie below a home folder.
PROJECTS = ".claude/projects"


def projects_root(environment: Mapping[str, str] | None = None) -> str:
    """The folder with a folder of session files for each project; any path that Spark reads."""
    env = os.environ if environment is None else environment
    return env.get(PROJECTS_SETTING) or os.path.join(_home(env), PROJECTS)


def store_root(environment: Mapping[str, str] | None = None) -> str:
    """The store's folder, below the user's data folder."""
    env = os.environ if environment is None else environment
    if at := env.get(STORE_SETTING):
        return at
    data = env.get("XDG_DATA_HOME") or os.path.join(_home(env), ".local", "share")
    return os.path.join(data, "lakeloom", "store")


def _home(env: Mapping[str, str]) -> str:
    home = env.get("HOME")
    if not home:
        raise ValueError(f"no home folder is set; set {PROJECTS_SETTING} and {STORE_SETTING}")
    return home
