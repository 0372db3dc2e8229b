"""A small writer of PDF files: lines of text and ruled tables, from the top of each page."""

from __future__ import annotations

import zlib

_LINE, _TOP, _LEFT, _EM = 14, 800, 50, 0.6


def _said(text: str) -> bytes:
    """A string operand; characters beyond Windows-1252 become question marks."""
    return b"(" + text.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b")"


def make_pdf(pages: list[list[tuple[str | None, list[list[str]] | None]]], size: int = 10) -> bytes:
    """Pages of (line of text, None) or (None, rows of a table), each below the one before. A page is as high as it has to be."""
    objects: list[bytes] = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier /Encoding /WinAnsiEncoding /FirstChar 0 /Widths [" + b"600 " * 256 + b"] >>"]
    kids = []
    for items in pages:
        y, out = _TOP, []
        show = lambda x, y, t: out.append(b"BT /F1 %d Tf %.2f %.2f Td %s Tj ET" % (size, x, y, _said(t)))
        for text, rows in items:
            if rows is None:
                show(_LEFT, y, text or "")
                y -= _LINE
                continue
            columns = max(map(len, rows), default=0)
            wide = [max(len(r[c]) if c < len(r) else 0 for r in rows) * size * _EM + 8 for c in range(columns)]
            xs = [_LEFT + sum(wide[:c]) for c in range(columns + 1)]
            top = y + size
            for i, r in enumerate(rows):
                for c, t in enumerate(r):
                    if t:
                        show(xs[c] + 4, y - i * _LINE, t)
            ys = [top - i * _LINE for i in range(len(rows) + 1)]
            out += [b"%.2f %.2f m %.2f %.2f l S" % (xs[0], b, xs[-1], b) for b in ys] + [b"%.2f %.2f m %.2f %.2f l S" % (a, ys[0], a, ys[-1]) for a in xs]
            y = ys[-1] - 2 * _LINE
        body = zlib.compress(b"\n".join(out))
        objects.append(b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(body), body))
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 %d 2000 842] /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (min(0, int(y) - 50), len(objects)))
        kids.append(b"%d 0 R" % len(objects))
    objects[1] = b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(kids), len(kids))
    out, places = b"%PDF-1.4\n", []
    for n, o in enumerate(objects, start=1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (n, o)
    table = b"".join(b"%010d 00000 n \n" % p for p in places)
    return out + b"xref\n0 %d\n0000000000 65535 f \n%strailer << /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, table, len(objects) + 1, len(out))
