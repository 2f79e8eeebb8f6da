"""Minimal class files for queries and tests: constant pool, members, nested-class and module attributes."""

from __future__ import annotations

import struct


class ClassBuilder:
    def __init__(self, name: str, super_name: str | None = "java/lang/Object", interfaces=(), flags: int = 0x21,
                 major: int = 52, minor: int = 0):
        self._items: list[bytes] = []
        self._index: dict = {}
        self._slots = 1
        self.major, self.minor, self.flags = major, minor, flags
        self.this_ref = self.klass(name)
        self.super_ref = self.klass(super_name) if super_name else 0
        self.interface_refs = [self.klass(i) for i in interfaces]
        self.members: dict[str, list[bytes]] = {"field": [], "method": []}
        self.attributes: list[bytes] = []

    def _add(self, key, raw: bytes, slots: int = 1) -> int:
        if key not in self._index:
            self._index[key] = self._slots
            self._items.append(raw)
            self._slots += slots
        return self._index[key]

    def utf8(self, text: str) -> int:
        raw = text.encode("utf-8").replace(b"\x00", b"\xc0\x80")
        return self._add(("u", text), struct.pack(">BH", 1, len(raw)) + raw)

    def klass(self, name: str) -> int:
        return self._add(("c", name), struct.pack(">BH", 7, self.utf8(name)))

    def string(self, text: str) -> int:
        return self._add(("s", text), struct.pack(">BH", 8, self.utf8(text)))

    def long(self, value: int) -> int:
        return self._add(("l", value), struct.pack(">Bq", 5, value), 2)

    def named(self, tag: int, name: str) -> int:
        """Module (19) or package (20) item."""
        return self._add((tag, name), struct.pack(">BH", tag, self.utf8(name)))

    def ref(self, tag: int, owner: str, name: str, descriptor: str) -> int:
        """Field (9), method (10) or interface method (11) reference."""
        pair = self._add(("n", name, descriptor), struct.pack(">BHH", 12, self.utf8(name), self.utf8(descriptor)))
        return self._add((tag, owner, name, descriptor), struct.pack(">BHH", tag, self.klass(owner), pair))

    def attribute(self, name: str, data: bytes) -> bytes:
        return struct.pack(">HI", self.utf8(name), len(data)) + data

    def member(self, kind: str, flags: int, name: str, descriptor: str, exceptions=(), signature: str | None = None,
               annotations=()) -> None:
        attrs = []
        if exceptions:
            attrs.append(self.attribute("Exceptions", struct.pack(
                f">H{len(exceptions)}H", len(exceptions), *[self.klass(e) for e in exceptions])))
        if signature:
            attrs.append(self.attribute("Signature", struct.pack(">H", self.utf8(signature))))
        if annotations:
            attrs.append(self.annotations(annotations))
        self.members[kind].append(
            struct.pack(">HHHH", flags, self.utf8(name), self.utf8(descriptor), len(attrs)) + b"".join(attrs))

    def annotations(self, descriptors) -> bytes:
        data = struct.pack(">H", len(descriptors))
        for d in descriptors:
            # One enum element per annotation.
            data += struct.pack(">HHHB", self.utf8(d), 1, self.utf8("level"), ord("e"))
            data += struct.pack(">HH", self.utf8("Lann/Level;"), self.utf8("HIGH"))
        return self.attribute("RuntimeVisibleAnnotations", data)

    def inner(self, rows) -> None:
        """Rows ``(inner, outer or None, simple or None, flags)``."""
        data = struct.pack(">H", len(rows))
        for inner, outer, simple, flags in rows:
            data += struct.pack(">HHHH", self.klass(inner), self.klass(outer) if outer else 0,
                                self.utf8(simple) if simple else 0, flags)
        self.attributes.append(self.attribute("InnerClasses", data))

    def module(self, name: str, requires=(), exports=(), opens=(), uses=(), provides=(), main: str | None = None):
        """``exports``/``opens``: (package, [modules]); ``provides``: (service, [types])."""
        h = lambda *v: struct.pack(f">{len(v)}H", *v)
        data = h(self.named(19, name), 0, 0, len(requires))
        for r in requires:
            data += h(self.named(19, r), 0, 0)
        for group in (exports, opens):
            data += h(len(group))
            for package, targets in group:
                data += h(self.named(20, package), 0, len(targets), *[self.named(19, t) for t in targets])
        data += h(len(uses), *[self.klass(u) for u in uses], len(provides))
        for service, types in provides:
            data += h(self.klass(service), len(types), *[self.klass(t) for t in types])
        self.attributes.append(self.attribute("Module", data))
        if main:
            self.attributes.append(self.attribute("ModuleMainClass", h(self.klass(main))))

    def build(self) -> bytes:
        body = struct.pack(">HHHH", self.flags, self.this_ref, self.super_ref, len(self.interface_refs))
        body += b"".join(struct.pack(">H", i) for i in self.interface_refs)
        for kind in ("field", "method"):
            body += struct.pack(">H", len(self.members[kind])) + b"".join(self.members[kind])
        body += struct.pack(">H", len(self.attributes)) + b"".join(self.attributes)
        head = struct.pack(">IHHH", 0xCAFEBABE, self.minor, self.major, self._slots)
        return head + b"".join(self._items) + body
