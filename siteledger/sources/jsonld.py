"""JSON-LD scripts to flat nodes. Invalid JSON is dropped as data; graphs are flattened at any depth."""

from __future__ import annotations

import json

OFFER = "struct<kind:string,types:array<string>,id:string,url:string,sku:string,item_id:string,price:string,low:string,high:string,currency:string,unit:string,availability:string,valid_until:string,customer:string,region:string,vat:string,least:string,step:string,most:string>"
PROPERTY = "struct<name:string,value:string,unit:string>"
VARIANT = f"struct<id:string,sku:string,name:string,properties:array<{PROPERTY}>,offers:array<{OFFER}>>"
#: An entry of an ordered list: position and name as spelled, and what it leads to.
LISTED = "struct<position:string,name:string,url:string>"
NODE = f"struct<ord:int,schema_org:boolean,classes:array<string>,url:string,id:string,name:string,description:string,sku:string,brand:string,author:string,date_published:string,properties:array<{PROPERTY}>,offers:array<{OFFER}>,variants:array<{VARIANT}>,listed:array<{LISTED}>>"


def _json(value) -> str | None:
    """A condition's value as it stands: compact JSON, null if there is none."""
    return None if value is None else json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _list(value) -> list:
    return value if isinstance(value, list) else [] if value is None else [value]


def _text(value) -> str | None:
    """Strings and exact numbers; of an object its name or value."""
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, dict):
        return _text(value.get("name", value.get("@id", value.get("value"))))
    if isinstance(value, list):
        return _text(value[0]) if len(value) == 1 else None
    return str(value).strip() or None


def _name(kind: str) -> str:
    return kind.rsplit("/", 1)[-1].rsplit("#", 1)[-1].removeprefix("schema:")


def _properties(node: dict) -> list[dict]:
    out = [{"name": _text(p.get("name")), "value": _text(p.get("value")), "unit": _text(p.get("unitText", p.get("unitCode")))} for p in _list(node.get("additionalProperty")) if isinstance(p, dict)]
    return [p for p in out if p["name"]]


def _offers(node: dict) -> list[dict]:
    out = []
    for o in _list(node.get("offers")):
        if not isinstance(o, dict):
            continue
        spec = next((s for s in _list(o.get("priceSpecification")) if isinstance(s, dict)), {})
        item = o.get("itemOffered") if isinstance(o.get("itemOffered"), dict) else {}
        pick = lambda name, a=o, b=spec: _text(a.get(name, b.get(name)))
        types = [_name(str(k)) for k in _list(o.get("@type"))]
        kind = "AggregateOffer" if "AggregateOffer" in types else "Offer"
        measure = spec.get("referenceQuantity") if isinstance(spec.get("referenceQuantity"), dict) else {}
        row = {"kind": kind, "types": types, "id": _text(o.get("@id")), "url": _text(o.get("url")), "sku": _text(o.get("sku")) or _text(item.get("sku")), "item_id": _text(item.get("@id")) or _text(item.get("url")), "price": pick("price"), "low": _text(o.get("lowPrice")), "high": _text(o.get("highPrice")), "currency": pick("priceCurrency"), "unit": _text(spec.get("unitText")) or _text(measure.get("unitText")), "availability": _text(o.get("availability")), "valid_until": _json(o.get("priceValidUntil")), "customer": _json(o.get("eligibleCustomerType")), "region": _json(o.get("eligibleRegion")), "vat": _json(spec.get("valueAddedTaxIncluded"))}
        allowed = o.get("eligibleQuantity") if isinstance(o.get("eligibleQuantity"), dict) else {}
        row |= {"least": _text(allowed.get("minValue")), "step": _text(allowed.get("stepValue")), "most": _text(allowed.get("maxValue"))}
        out.append(row)
        if kind == "AggregateOffer":
            out.extend(_offers(o))
    return out


def _listed(node: dict) -> list[dict]:
    out = []
    for entry in _list(node.get("itemListElement")):
        if isinstance(entry, dict):
            item = entry.get("item")
            url = _text(item.get("@id", item.get("url"))) if isinstance(item, dict) else _text(item)
            out.append({"position": _text(entry.get("position")), "name": _text(entry.get("name")) or (_text(item.get("name")) if isinstance(item, dict) else None), "url": url or _text(entry.get("url"))})
    return out


def nodes(scripts: list[str]) -> list[dict]:
    out: list[dict] = []

    def add(node, schema_org: bool) -> None:
        if isinstance(node, list):
            for n in node:
                add(n, schema_org)
            return
        if not isinstance(node, dict):
            return
        own = any("schema.org" in str(c) for c in _list(node.get("@context"))) or schema_org
        if "@type" in node:
            variants = [{"id": _text(v.get("@id")) or _text(v.get("url")), "sku": _text(v.get("sku")), "name": _text(v.get("name")), "properties": _properties(v), "offers": _offers(v)} for v in _list(node.get("hasVariant")) if isinstance(v, dict)]
            out.append({"ord": len(out), "schema_org": own, "classes": [_name(str(k)) for k in _list(node["@type"])], "url": _text(node.get("url")), "id": _text(node.get("@id")), "name": _text(node.get("name", node.get("headline"))), "description": _text(node.get("description")), "sku": _text(node.get("sku")), "brand": _text(node.get("brand", node.get("manufacturer"))), "author": _text(node.get("author")), "date_published": _text(node.get("datePublished")), "properties": _properties(node), "offers": _offers(node), "variants": variants, "listed": _listed(node)})
        add(node.get("@graph"), own)

    for script in scripts:
        try:
            add(json.loads(script, parse_float=str), False)
        except (ValueError, RecursionError):
            continue
    return out
