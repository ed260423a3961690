"""The trees of single seeds by plain traversal, for comparison: a walk through tables of Python rows, stage by stage."""

from collections import defaultdict

AFFIXES = {"af", "affix", "suffix", "suf", "prefix", "pre", "compound", "confix", "blend"}


def first(x):
    """Missing values before others."""
    return (x is not None, x if x is not None else 0)


class Model:
    """``entries``: rows of a dictionary; ``names``: code to language; ``components``: (to_word, to_lang) to the existing
    (from_word, from_lang, type); ``classes``: entry_id to the type of its uncertainty; ``fold``: the normalised form."""

    def __init__(self, entries, names, components, classes, fold, types, up=10, down=3, cap=50):
        self.names, self.components, self.classes, self.fold = names, components, classes, fold
        self.types, self.up, self.down, self.cog = [t for t in types if t != "cog"], up, down, "cog" in types
        self.codes = {}
        for code, name in names.items():
            self.codes[name] = min(code, self.codes.get(name, code))
        self.by_id = {e["entry_id"]: e for e in entries}
        self.one, self.numbered, named = {}, {}, defaultdict(list)
        order = lambda e: (first(e["pos"]), first(e["etymology_number"]), e["entry_id"])
        for e in sorted(entries, key=order):
            self.one.setdefault((e["word"], e["lang"]), e)
            if e["etymology_number"] is not None:
                self.numbered.setdefault((e["word"], e["lang"], e["etymology_number"]), e)
            for parent in {(w, c) for w, c, _ in self.ancestry(e)}:
                named[parent].append(e)
        self.children = {}
        for (word, code), all_ in named.items():
            seen, out = set(), []
            for e in sorted(all_, key=lambda e: (e["word"], e["lang"], *order(e)))[:cap]:
                if (e["word"], e["lang"]) not in seen:
                    seen.add((e["word"], e["lang"]))
                    w, c, t = self.ancestry(e)[0]
                    if (w, c) == (word, code):
                        out.append((e["word"], e["lang"], e["lang_code"], t))
            self.children[word, code] = out

    @staticmethod
    def templates(e):
        return [(t["name"], t["args"] or {}) for t in e["etymology_templates"] or []]

    def ancestry(self, e, types=None):
        types = self.types if types is None else types
        found = [(a.get("3"), a.get("2"), {"derived": "der"}.get(n, n)) for n, a in self.templates(e) if {"derived": "der"}.get(n, n) in types]
        return [x for x in found if x[0] and x[1]]

    def mentions(self, e):
        """word, language and role, the first of each word and code."""
        ancestors, out = {(w, c) for w, c, _ in self.ancestry(e, ["inh", "bor", "der"])}, {}
        for n, a in self.templates(e):
            if a.get("1") and n in ("m", "m+", "l"):
                words, role = [a.get("2")], "mention"
            elif a.get("1") and n in AFFIXES:
                words, role = [w for w in (a.get(k) for k in "2345") if w and not w.startswith("-") and not w.endswith("-")], "component"
            else:
                continue
            for w in words:
                if w and (w, a["1"]) not in ancestors:
                    out.setdefault((w, a["1"]), role)
        return [(w, self.names.get(c, c), role) for (w, c), role in out.items()]

    def find(self, word, lang, etym=None):
        return self.numbered.get((word, lang, etym)) or self.one.get((word, lang)) or self.one.get((self.fold(word), lang))

    def build(self, word, lang, etym=None):
        """Nodes: id to (label, language, level, uncertainty); edges: (from, to) to label."""
        self.found, self.edges, self.at = defaultdict(list), {}, 0
        self.skip = {f"{word}:{lang}"} if etym is not None else set()
        self.expand([(word, lang, 0, etym)])
        done = set()
        for _ in range(2 if self.cog else 0):
            nodes, links, new = self.nodes(), [], {}
            for i, (label, language, level, _) in nodes.items():
                e = self.find(label, language) if i not in done else None
                for n, a in self.templates(e) if e else []:
                    if n == "cog" and a.get("1") and a.get("2"):
                        w, own = a["2"], self.names.get(a["1"], a["1"])
                        links.append((i, f"{w}:{own}", "cog", 0, None))
                        if f"{w}:{own}" not in nodes:
                            new[w, own] = min(new.get((w, own), (abs(level), level)), (abs(level), level))
            done = set(nodes)
            self.link(links)
            if not new:
                break
            self.expand([(w, own, level, None) for (w, own), (_, level) in new.items()])
        return self.nodes(), self.edges

    def nodes(self):
        out = {}
        for i, rows in self.found.items():
            _, _, level, label, language, _ = min(rows, key=lambda r: r[:3])
            known = [r for r in rows if r[5] is not None]
            out[i] = (label, language, level, min(known, key=lambda r: r[:3])[5] if known else None)
        return out

    def node(self, word, lang, level, uncertainty=None):
        self.found[f"{word}:{lang}"].append((self.at, abs(level), level, word, lang, uncertainty))

    def link(self, rows):
        """(from, to, label, level, payload): what is new, once."""
        best = {}
        for a, b, label, level, payload in rows:
            key = (label, abs(level), level)
            if (a, b) not in self.edges and ((a, b) not in best or key < best[a, b][0]):
                best[a, b] = key, payload
        for k, (key, _) in best.items():
            self.edges[k] = key[0]
        self.at += 1
        return [(key[2], payload) for key, payload in best.values()]

    def chain(self, found):
        words, links = set(), []
        for word, lang, level, e in found:
            words.add((word, lang, self.codes.get(lang, lang), level))
            before = f"{word}:{lang}"
            for k, (w, code, kind) in enumerate(self.ancestry(e)[: self.up], 1):
                own = self.names.get(code, code)
                self.node(w, own, level - k)
                links.append((f"{w}:{own}", before, kind, 0, None))
                words.add((w, own, code, level - k))
                before = f"{w}:{own}"
        self.link(links)
        return words

    def expand(self, wanted):
        located = [(w, lang, level, self.find(w, lang, etym)) for w, lang, level, etym in wanted]
        for w, lang, level, e in located:
            self.node(w, lang, level, self.classes.get(e["entry_id"]) if e else None)
        located = [x for x in located if x[3]]
        chain = self.chain(located)
        links = []
        for w, lang, level, e in located:
            for m, own, role in self.mentions(e) if not self.ancestry(e) else []:
                if self.find(m, own):
                    self.node(m, own, level - 1)
                    links.append((f"{m}:{own}", f"{w}:{lang}", role, 0, None))
        self.link(links)
        words = chain
        for left in (3, 2, 1):
            links = []
            for w, lang, _, level in words:
                for part, own, kind in self.components.get((w, lang), ()):
                    self.node(part, own, level - 1)
                    links.append((f"{part}:{own}", f"{w}:{lang}", kind, level, (part, own)))
            new = self.link(links)
            if left == 1 or not new:
                break
            traced = {(part, own, level - 1) for level, (part, own) in new}
            words = self.chain([(p, own, level, e) for p, own, level in traced if (e := self.find(p, own))])
        frontier = [x for x in chain if f"{x[0]}:{x[1]}" not in self.skip]
        for _ in range(self.down):
            links = []
            for w, lang, code, level in frontier:
                for child, own, own_code, kind in self.children.get((w, code), ()):
                    self.node(child, own, level + 1)
                    links.append((f"{w}:{lang}", f"{child}:{own}", kind, level, (child, own, own_code)))
            new = self.link(links)
            frontier = [(child, own, code, level + 1) for level, (child, own, code) in new if f"{child}:{own}" not in self.skip]
            if not new:
                break
