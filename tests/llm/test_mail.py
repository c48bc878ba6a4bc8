"""Mail decoding against Python's own parser and written cases."""

import base64
import email
import quopri

from trellis.llm import mail

PLAIN = "From: a@x.example\nSubject: s\nContent-Type: text/plain; charset=utf-8\n\nHallo\n\nEin Text über\nzwei Zeilen.\n\n> quoted line\n\nmehr Text\n\n-- \nName\n"


def test_plain_and_crlf():
    for source in (PLAIN, PLAIN.replace("\n", "\r\n")):
        assert mail.own_paragraphs(source) == ["Hallo", "Ein Text über\nzwei Zeilen.", "mehr Text"]
        assert "quoted line" in mail.readable(source)[0]


def test_nothing():
    assert mail.parts(None) == mail.parts("") == mail.parts(" \n\t ") == [] and mail.own_paragraphs("") == []


def test_encodings():
    text = "Größe – déjà vu\n"
    b64, qp = base64.encodebytes(text.encode()).decode(), quopri.encodestring(text.encode("iso-8859-1", "replace")).decode()
    head = "From: a@x\nContent-Type: text/plain; charset={}\nContent-Transfer-Encoding: {}\n\n"
    assert mail.readable(head.format("utf-8", "base64") + b64) == [text]
    assert mail.readable(head.format('"utf-8"', "BASE64") + b64[:-6])[0].startswith("Größe")
    assert mail.readable(head.format("ISO-8859-1", "quoted-printable") + qp)[0].startswith("Größe")
    assert mail.readable(head.format("x-unknown", "base64") + b64) == [text]


def test_lost_headers():
    assert mail.readable("Hello there:\n\nbody") == ["Hello there:\n\nbody"]
    body = "--=_abc\nContent-Type: text/plain\n\nfirst\n--=_abc\nContent-Type: text/html\n\n<p>second</p>\n--=_abc--\n"
    assert [x.strip() for x in mail.readable(body)] == ["first", "second"]


def multipart(kind, *parts):
    return f'From: a@x\nMIME-Version: 1.0\nContent-Type: multipart/{kind};\n boundary="BB"\n\npreamble\n' + "".join(f"--BB\n{p}\n" for p in parts) + "--BB--\n"


def test_alternatives_and_attachments():
    html = "Content-Type: text/html; charset=utf-8\n\n<html><head><style>p{}</style></head><body><p>On<b>e</b> &amp; two</p><blockquote>old <blockquote>older</blockquote></blockquote><div>three</div><hr><p>legal</p></body></html>"
    plain = "Content-Type: text/plain\n\nOne & two\n\nthree\n"
    attached = "Content-Type: text/plain; name=a.txt\nContent-Disposition: attachment\n\nfile words\n"
    both = multipart("alternative", plain, html)
    assert mail.own_paragraphs(both) == ["One & two", "three"]
    assert mail.own_paragraphs(multipart("alternative", html)) == ["One & two", "three"]
    assert mail.own_paragraphs(multipart("alternative", "Content-Type: text/plain\n\n  \n", html)) == ["One & two", "three"]
    assert mail.own_paragraphs(multipart("mixed", plain, attached)) == ["One & two", "three"] and len(mail.readable(multipart("mixed", plain, attached))) == 2
    cut = both[: both.index("<div>three")]
    assert "older" in mail.readable(cut)[1]
    parsed = [p.get_payload() for p in email.message_from_string(both).walk() if p.get_content_maintype() == "text"]
    assert [p.text.strip() for p in mail.parts(both)] == [p.strip() for p in parsed]


def test_cuts():
    for end in ("-----Original Message-----\nFrom: b\n\nold", "________________________\nlegal", "-- \nsig\n\nmore"):
        assert mail.own_paragraphs(f"From: a@x\n\nown words\n\n{end}\n") == ["own words"]
    assert mail.own_paragraphs("From: a@x\n\nown\n\nOn Monday B wrote:\n\n> x\n> y\n\nagain\n") == ["own", "again"]


def test_long_text():
    assert len(mail.readable("From: a@x\n\n" + "word " * 400_000)[0]) == 2_000_000
