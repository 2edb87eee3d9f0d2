"""A thin HTTP service over an engine: ``/search``, ``/rag``, and a page that asks both.

Two requests at a time don't get into each other's way: an engine is never
changed, and one with new records takes the place of the old in a single step.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from corpusloom.api import Engine, Web
from corpusloom.functions.constants import API_TOP_K, PAGE_SIZE, RAG_CHARS, RAG_SENTENCES, RAG_TOP_K, UI_TOP_K

UI_SENTENCES, UI_CHARS = 4, 600
#: Labels of the page by language.
LABELS = {
    "en": {"search": "Search", "answer": "Answer", "sources": "Sources", "none": "No results", "previous": "Previous", "next": "Next", "pdf": "PDF", "image": "Image", "video": "Video", "document": "Document", "other": "Other"},
    "es": {"search": "Buscar", "answer": "Respuesta", "sources": "Fuentes", "none": "Sin resultados", "previous": "Anterior", "next": "Siguiente", "pdf": "PDF", "image": "Imagen", "video": "Vídeo", "document": "Documento", "other": "Otro"},
}
PAGE = """<!doctype html><html><head><meta charset="utf-8"><title>Corpusloom</title>
<style>body{font:16px sans-serif;max-width:46em;margin:2em auto}li{margin:1em 0}small{color:#666}</style></head>
<body><form id="f"><input id="q" size="50"> <button id="go"></button></form><section id="a"></section><ol id="r"></ol><nav id="n"></nav>
<script>
const T = __LABELS__, L = T[(navigator.language || "").slice(0, 2) === "en" ? "en" : "es"], SIZE = __SIZE__;
const kinds = {PDF: "pdf", IMAGEN: "image", VIDEO: "video", DOCUMENTO: "document"};
const el = (id) => document.getElementById(id), add = (to, tag, text) => { const x = document.createElement(tag); x.textContent = text; to.appendChild(x); return x; };
let rows = [], page = 0;
function show() {
  el("r").replaceChildren(); el("n").replaceChildren(); el("r").start = page * SIZE + 1;
  if (!rows.length) add(el("r"), "p", L.none);
  for (const x of rows.slice(page * SIZE, (page + 1) * SIZE)) {
    const li = add(el("r"), "li", ""), a = add(li, "a", x.title);
    if (/^https?:/.test(x.url)) a.href = x.url;
    add(li, "p", x.snippet);
    add(li, "small", [L[kinds[x.file_type] || "other"], x.domain, (x.crawl_date || "").split("T")[0]].filter(Boolean).join(" · "));
  }
  for (const [step, name] of [[-1, "previous"], [1, "next"]])
    if (page + step >= 0 && (page + step) * SIZE < rows.length) add(el("n"), "button", L[name]).onclick = () => { page += step; show(); };
}
el("go").textContent = L.search;
el("f").onsubmit = async (e) => {
  e.preventDefault();
  const q = encodeURIComponent(el("q").value);
  const [s, r] = await Promise.all([fetch("/search?top_k=__TOP__&query=" + q), fetch("/rag?top_k=__RAG__&max_sentences=__SENTENCES__&max_chars=__CHARS__&query=" + q)].map((p) => p.then((x) => x.json())));
  el("a").replaceChildren();
  if (r.answer) { add(el("a"), "h2", L.answer); add(el("a"), "p", r.answer); add(el("a"), "small", L.sources + ": " + r.sources.map((d) => d.title || d.url).join("; ")); }
  rows = s.results; page = 0; show();
};
</script></body></html>"""


def page() -> str:
    out = PAGE
    for name, value in (("LABELS", json.dumps(LABELS)), ("SIZE", PAGE_SIZE), ("TOP", UI_TOP_K), ("RAG", RAG_TOP_K), ("SENTENCES", UI_SENTENCES), ("CHARS", UI_CHARS)):
        out = out.replace(f"__{name}__", str(value))
    return out


def number(args: dict, name: str, default: int) -> int:
    """A parameter as a number; the default where it is none."""
    try:
        return int(args.get(name, [default])[0])
    except ValueError:
        return default


class Service:
    """What the endpoints answer, without HTTP."""

    def __init__(self, engine: Engine, web: Web | None = None, generator: Callable[[str], str] | None = None):
        self.engine, self.web, self.generator = engine, web, generator

    def search(self, args: dict) -> dict:
        query = args.get("query", [""])[0].strip()
        out, self.engine = self.engine.respond(query, max(1, number(args, "top_k", API_TOP_K)), self.web)
        return out

    def rag(self, args: dict) -> dict:
        query = args.get("query", [""])[0].strip()
        if not query:
            return {"query": query, "answer": "", "sources": [], "contexts": [], "total_sources": 0}
        how = number(args, "top_k", RAG_TOP_K), number(args, "max_sentences", RAG_SENTENCES), number(args, "max_chars", RAG_CHARS)
        row = self.engine.answer(query, *how, self.generator, self.web).first().asDict(recursive=True)
        return {"query": query, "answer": row["answer"], "sources": row["used"], "contexts": row["contexts"], "total_sources": row["total_sources"], "web_search_used": row["web_search_used"]}


def server(service: Service, host: str = "127.0.0.1", port: int = 5000) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            url = urlsplit(self.path)
            found = {"/search": service.search, "/rag": service.rag}.get(url.path)
            if found is None and url.path != "/":
                return self.send_error(404)
            body = page() if found is None else json.dumps(found(parse_qs(url.query)), ensure_ascii=False, default=str)
            data = body.encode("utf-8")
            self.send_response(200)
            self.send_header("Content-Type", ("text/html" if found is None else "application/json") + "; charset=utf-8")
            self.send_header("Access-Control-Allow-Origin", "*")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer((host, port), Handler)
