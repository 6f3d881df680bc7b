"""Reference tables of the curation layer, what online services send, and clients that the caller's fetch feeds.

No request is made here: a client takes a function of an address that gives
text, so it works offline, on recorded answers and behind any transport.
"""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quiltframe.operators.resolvers import Bucket
from quiltframe.sources.store import Store


def _record(text: str = "", arrays: str = "", longs: str = "", bools: str = "", doubles: str = "") -> T.StructType:
    kinds = ((text, T.StringType()), (arrays, T.ArrayType(T.StringType())), (longs, T.LongType()), (bools, T.BooleanType()), (doubles, T.DoubleType()))
    return T.StructType([T.StructField(n, k) for names, k in kinds for n in names.split()])


RECORDS = {
    "organisms": _record("common_name scientific_name", longs="taxon"),
    "organism_prefixes": _record("prefix organism"),
    "genes": _record("id symbol organism assembly biotype", longs="ncbi_id"),
    "gene_aliases": _record("alias id organism", bools="canonical"),
    "proteins": _record("id name gene organism sequence", longs="length"),
    "protein_aliases": _record("alias id organism", bools="canonical"),
    "compounds": _record("id title smiles formula", doubles="weight"),
    "compound_synonyms": _record("name id", bools="is_title"),
    "ontology": _record("term_id name synonyms definition", arrays="parents", bools="obsolete"),
    "cell_lines": _record("id name organism disease sex", arrays="synonyms"),
    "guide_cache": _record("value gene chrom strand", longs="start end"),
}


class Reference:
    """The reference tables of a folder, made when first asked for."""

    def __init__(self, spark: SparkSession, root: str):
        self.store = Store(spark, root)

    def table(self, name: str) -> DataFrame:
        if name not in RECORDS:
            raise KeyError(name)
        if self.store.version(name) < 0:
            self.store.create(name, RECORDS[name])
        return self.store.read(name)

    def tables(self) -> dict[str, DataFrame]:
        return {n: self.table(n) for n in RECORDS}

    def load(self, name: str, batches: Iterable[list[dict]]) -> int:
        """Appends batches of records one after another; gives how many rows. A record of unknown fields is refused."""
        self.table(name)
        n = 0
        for batch in batches:
            if unknown := {k for r in batch for k in r} - set(RECORDS[name].fieldNames()):
                raise ValueError(f"{name} has no fields {sorted(unknown)}")
            self.store.append(name, self.store.spark.createDataFrame([tuple(r.get(f) for f in RECORDS[name].fieldNames()) for r in batch], RECORDS[name]))
            n += len(batch)
        return n

    def optimise(self, name: str, key: str) -> None:
        """One folder, sorted by the key that lookups use, so that their ranges prune row groups; the newest of equal rows stays."""
        version = self.store.version(name)
        self.store.rewrite(name, self.table(name).dropDuplicates().repartitionByRange(key).sortWithinPartitions(key), version)


# what services send

def iri(curie: str) -> str:
    prefix, colon, rest = curie.partition(":")
    if not colon:
        raise ValueError(f"{curie!r} has no prefix")
    return f"http://purl.obolibrary.org/obo/{prefix}_{rest}"


def term(doc: dict) -> dict:
    """A record of the ontology table from a lookup service's document."""
    names = doc.get("synonyms") or doc.get("synonym") or []
    text = doc.get("description")
    return {"term_id": doc.get("obo_id") or doc["short_form"].replace("_", ":", 1), "name": doc.get("label"), "synonyms": " | ".join(n["name"] if isinstance(n, dict) else n for n in names), "definition": text[0] if isinstance(text, list) and text else text or None, "parents": [], "obsolete": bool(doc.get("is_obsolete", False))}


def soft(text: str) -> dict[str, list[str]]:
    """The attributes of a series or sample in the family format: key to values, in order."""
    out: dict[str, list[str]] = {}
    for line in text.splitlines():
        if line.startswith("!") and " = " in line:
            key, _, value = line[1:].partition(" = ")
            out.setdefault(key.strip(), []).append(value.strip())
    return out


def characteristics(values: list[str]) -> dict[str, str]:
    """What "key: value" texts say; the first of a key counts."""
    out: dict[str, str] = {}
    for v in values:
        key, colon, rest = v.partition(":")
        if colon:
            out.setdefault(key.strip().lower(), rest.strip())
    return out


def flat(record: object, prefix: str = "") -> dict[str, str]:
    """Nested records in one level, names joined by dots, lists by "; "."""
    if isinstance(record, dict):
        return {k: v for name, x in record.items() for k, v in flat(x, f"{prefix}{name}." if isinstance(x, dict) else f"{prefix}{name}").items()}
    if isinstance(record, (list, tuple)):
        return {prefix: "; ".join(map(str, record))}
    return {prefix: "" if record is None else str(record)}


def id_kind(value: str) -> str:
    """doi, pmid, pmcid or an accession's database."""
    v = value.strip()
    for kind, pattern in (("doi", r"10\.\d{4,9}/\S+"), ("pmcid", r"PMC\d+"), ("pmid", r"\d{1,8}"), ("geo", r"G(SE|SM|PL|DS)\d+"), ("biosample", r"SAM[NED][A-Z]?\d+"), ("bioproject", r"PRJ[A-Z]{2}\d+"), ("sra", r"[SED]R[PRXSA]\d+")):
        if re.fullmatch(pattern, v, re.I):
            return kind
    raise ValueError(f"{value!r} is no identifier that is known")


def _date(node: ET.Element | None) -> str | None:
    if node is None or node.findtext("Year") is None:
        return None
    months = "jan feb mar apr may jun jul aug sep oct nov dec".split()
    month = (node.findtext("Month") or "1").lower()[:3]
    m = months.index(month) + 1 if month in months else int(month)
    return f"{int(node.findtext('Year')):04d}-{m:02d}-{int(node.findtext('Day') or 1):02d}"


def publications(xml: str) -> list[dict]:
    """pmid, doi, title, journal, date and the sections of each abstract."""
    out = []
    for a in ET.fromstring(xml).iter("PubmedArticle"):
        ids = {n.get("IdType"): n.text for n in a.iter("ArticleId")}
        sections = [{"label": n.get("Label") or "", "text": "".join(n.itertext()).strip()} for n in a.iter("AbstractText")]
        title = a.find(".//ArticleTitle")
        out.append({"pmid": a.findtext(".//PMID"), "doi": ids.get("doi"), "title": "".join(title.itertext()).strip() if title is not None else None, "journal": a.findtext(".//Journal/Title"), "date": _date(a.find(".//PubDate")), "sections": sections})
    return out


def biosamples(xml: str) -> list[dict]:
    """accession, organism and attributes of each sample."""
    out = []
    for s in ET.fromstring(xml).iter("BioSample"):
        org = s.find(".//Organism")
        out.append({"accession": s.get("accession"), "organism": org.get("taxonomy_name") if org is not None else None, "attributes": {n.get("harmonized_name") or n.get("attribute_name"): (n.text or "").strip() for n in s.iter("Attribute")}})
    return out


def listing(text: str) -> list[tuple[str, int | None]]:
    """Names and sizes in a folder's listing, as pages of links or as lines of ls."""
    links = re.findall(r'href="([^"?/.][^"]*)"[^\n]*?(?:\s(\d+(?:\.\d+)?)([KMG])?)?\s*$', text, re.M)
    if links:
        scale = {"": 1, "K": 1 << 10, "M": 1 << 20, "G": 1 << 30}
        return [(n, int(float(x) * scale[u]) if x else None) for n, x, u in links]
    rows = [line.split(None, 8) for line in text.splitlines() if line[:1] in "-d" and len(line.split(None, 8)) == 9]
    return [(r[8], int(r[4])) for r in rows]


# clients

class Client:
    """Addresses under a base, asked through fetch at the pace of a bucket; an answer is kept for the next time."""

    def __init__(self, base: str, fetch: Callable[[str], str], rate: float = 3.0):
        self.base, self.fetch, self.bucket, self.kept = base.rstrip("/"), fetch, Bucket(rate), {}

    def get(self, path: str) -> str:
        if path not in self.kept:
            self.bucket.take()
            self.kept[path] = self.fetch(f"{self.base}/{path}")
        return self.kept[path]

    def json(self, path: str) -> dict:
        return json.loads(self.get(path))


class OntologyService(Client):
    """Terms of a lookup service."""

    def search(self, query: str, ontology: str | None = None, exact: bool = False) -> list[dict]:
        only = f"&ontology={ontology.lower()}" if ontology else ""
        docs = self.json(f"search?q={quote(query)}&exact={str(exact).lower()}{only}")["response"]["docs"]
        return [term(d) for d in docs]

    def _terms(self, path: str) -> list[dict]:
        return [term(d) for d in self.json(path).get("_embedded", {}).get("terms", [])]

    def term(self, curie: str) -> dict | None:
        got = self._terms(f"terms?iri={quote(iri(curie), safe='')}")
        return got[0] if got else None

    def replacement(self, curie: str) -> str | None:
        """What a withdrawn term is replaced by."""
        docs = self.json(f"terms?iri={quote(iri(curie), safe='')}").get("_embedded", {}).get("terms", [])
        by = docs[0].get("term_replaced_by") if docs else None
        return by.replace("_", ":", 1).rpartition("/")[2] if by else None

    def _related(self, curie: str, what: str) -> list[dict]:
        twice = quote(quote(iri(curie), safe=""), safe="")
        return self._terms(f"ontologies/{curie.partition(':')[0].lower()}/terms/{twice}/{what}")

    def ancestors(self, curie: str) -> list[dict]:
        return self._related(curie, "ancestors")

    def descendants(self, curie: str) -> list[dict]:
        return self._related(curie, "descendants")

    def exact(self, name: str, ontology: str) -> str | None:
        """The id of the one term of this name or synonym, for a resolver's last step."""
        hits = {t["term_id"] for t in self.search(name, ontology, True) if name.lower() in {(t["name"] or "").lower(), *t["synonyms"].lower().split(" | ")}}
        return hits.pop() if len(hits) == 1 else None


class Archive(Client):
    """Publications, samples and links between accessions of an archive of records."""

    def publications(self, ids: list[str]) -> list[dict]:
        return publications(self.get(f"efetch?db=pubmed&id={','.join(ids)}&retmode=xml"))

    def samples(self, ids: list[str]) -> list[dict]:
        return biosamples(self.get(f"efetch?db=biosample&id={','.join(ids)}&retmode=xml"))

    def series(self, accession: str) -> dict[str, list[str]]:
        return soft(self.get(f"geo?acc={accession}&targ=self&form=text&view=full"))

    def linked(self, source: str, target: str, uid: str) -> list[str]:
        sets = self.json(f"elink?dbfrom={source}&db={target}&id={uid}&retmode=json").get("linksets", [])
        return [x for s in sets for db in s.get("linksetdbs", []) for x in db.get("links", [])]

    def files(self, accession: str) -> list[tuple[str, int | None]]:
        stub = re.sub(r"\d{1,3}$", "nnn", accession)
        return listing(self.get(f"geo/series/{stub}/{accession}/suppl/"))


def download(names: Iterable[str], read: Callable[[str], bytes], folder: str) -> Iterator[str]:
    """Copies files into a folder of any file system; what is there stays."""
    from pyarrow import fs as pafs

    fs, root = pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    fs.create_dir(root, recursive=True)
    for name in names:
        path = f"{root}/{name}"
        if fs.get_file_info(path).type == pafs.FileType.NotFound:
            with fs.open_output_stream(f"{path}.part") as f:
                f.write(read(name))
            fs.move(f"{path}.part", path)
        yield path
