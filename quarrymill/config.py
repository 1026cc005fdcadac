"""Options: what is given in the call comes first, then a file's, then the default. Explicit ``False`` and 0 count as given."""

from __future__ import annotations

from typing import Any

#: Defaults by command.
DEFAULTS: dict[str, dict[str, Any]] = {
    "links": {"base_url": None, "dir": ".", "concurrency": 25, "output": "links_report.json", "dry_run": False},
    "parse": {"dir": ".", "output": "mdx_errors_report.json", "dry_run": False},
    "codeblocks": {"dir": ".", "threshold": 15, "expandable": True, "lines": False, "wrap": False, "dry_run": False},
    "inlineimages": {"dir": ".", "dry_run": False},
    "images": {"dir": ".", "download": False, "output": "images", "dry_run": False},
    "h1": {"dir": ".", "dry_run": False},
    "metadata": {"base_url": None, "dir": ".", "concurrency": 15, "tags": ["og:title", "og:description", "og:image", "og:url", "og:type", "og:site_name", "twitter:card"], "dry_run": False},
    "imports": {"dir": ".", "snippets": "snippets", "dry_run": False},
    "tabs": {"dir": ".", "dry_run": False},
    "nav": {"docs": "docs.json", "base": True, "rename": False, "skip_levels": [], "dry_run": False},
    "redirects": {"dir": ".", "docs": "docs.json", "dry_run": False},
    "nav_root": {"docs": "docs.json", "dry_run": False},
    "site": {"dir": ".", "output": "output", "dry_run": False},
    "scrape": {"output": "output", "concurrency": 3, "content_selector": "body", "dry_run": False},
    "pages": {"base_url": None, "docs": "docs.json", "concurrency": 20, "batch": 100, "output": "pages_report.json"},
    "image_check": {"base_url": None, "docs": "docs.json", "concurrency": 10, "output": "images_report.json"},
    "katex": {"base_url": None, "docs": "docs.json", "concurrency": 50, "output": "katex_report.json"},
    "find_redirects": {"base_url": None, "input": "broken_links.txt", "delay_ms": 500, "output": "redirects.json"},
    "hub": {"dir": ".", "output": "output", "dry_run": False},
    "hub_nav": {"docs": "docs.json", "base": True, "dry_run": False},
}


def merged(command: str, given: dict[str, Any] | None = None, file: dict[str, Any] | None = None) -> dict[str, Any]:
    """Options of ``command``; numbers may come as text."""
    out = {}
    for key, default in DEFAULTS[command].items():
        value = next((src[key] for src in (given or {}, file or {}) if src.get(key) is not None), default)
        if isinstance(default, int) and not isinstance(default, bool) and isinstance(value, str):
            value = int(value)
        out[key] = value
    return out


def required(options: dict[str, Any], *keys: str) -> dict[str, Any]:
    missing = [k for k in keys if options.get(k) in (None, "")]
    if missing:
        raise ValueError(f"missing option: {', '.join(missing)}")
    return options
