"""Arguments of the daemon from environment variables, as a container sets them."""

from __future__ import annotations

from .functions.codecs import roots_of


def arguments(env: dict[str, str]) -> list[str]:
    """The daemon's arguments from TWINSIFT_CONFIG, TWINSIFT_DATA, TWINSIFT_MODE and LOG_LEVEL; ValueError tells what is wrong."""
    if not env.get("TWINSIFT_CONFIG") or not env.get("TWINSIFT_DATA"):
        raise ValueError("the environment names no TWINSIFT_CONFIG or no TWINSIFT_DATA")
    roots = roots_of(env["TWINSIFT_DATA"])
    if not roots:
        raise ValueError("TWINSIFT_DATA names no root")
    mode = env.get("TWINSIFT_MODE") or "apply"
    if mode not in ("apply", "dry-run"):
        raise ValueError("TWINSIFT_MODE is neither apply nor dry-run")
    level = ["--log-level", env["LOG_LEVEL"]] if env.get("LOG_LEVEL") else []
    return ["--config", env["TWINSIFT_CONFIG"], *(["--apply"] if mode == "apply" else []), *level, *roots]
