"""Service configuration files: key = value lines, # or ; for comments."""

from __future__ import annotations

from dataclasses import dataclass, field

from nimbusvec.schema import Params

TRUE = ("1", "true", "on", "yes")
LISTS = ("servers", "clients")


def parse(text: str) -> dict[str, str | list[str]]:
    """The settings of a file's text; keys of several words are lists, later lines win."""
    out: dict[str, str | list[str]] = {}
    for line in text.splitlines():
        body = line.split("#")[0].split(";")[0].strip()
        if not body or body.startswith("["):
            continue
        key, eq, value = body.partition("=")
        if not eq:
            raise ValueError(f"not a setting: {line!r}")
        key, value = key.strip().replace("_", "-"), value.strip()
        out[key] = value.split() if key in LISTS else value
    return out


def flag(value: str) -> bool:
    return value.strip().lower() in TRUE


@dataclass
class Service:
    """Settings of a service, with the index parameters among them."""

    params: Params
    servers: list[str] = field(default_factory=list)
    clients: list[str] = field(default_factory=list)
    k: int = 10
    routing: bool = False
    mode: str = "quantized"
    index_prefix: str = ""
    other: dict = field(default_factory=dict)


def service(text: str) -> Service:
    s = parse(text)
    take = lambda key, kind, default: kind(s.pop(key, default))
    params = Params(
        dim=take("dim", int, 128), degree=take("r", int, s.pop("R", 32)), beam_width=take("beam-width", int, 32), beam_width_construction=take("beam-width-construction", int, 64),
        alpha=take("alpha", float, 1.2), bits=take("rabitq-bits", int, 4), metric="ip" if flag(str(s.pop("ip-dist", "0"))) else "l2", shards=max(1, len(s.get("servers", [])) or 1),
    )
    if (k := take("k", int, 10)) > params.beam_width:
        raise ValueError("k may not exceed the beam width")
    mode = {"exact_gpu": "exact", "rabitq_gpu": "quantized"}.get(str(m := s.pop("search-mode", "quantized")), str(m))
    return Service(params, list(s.pop("servers", [])), list(s.pop("clients", [])), k, flag(str(s.pop("routing", "0"))), mode, str(s.pop("index-prefix", "")), s)
