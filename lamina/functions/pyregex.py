"""Character classes in Java's syntax that match as Python's Unicode classes do."""

from __future__ import annotations

#: The separators beyond ASCII (Unicode's category Z), as a class and one by one.
_SEPARATORS = r"\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS_CHARS = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: The insides of classes: white space, digits, word characters. Plain ranges come first: they are cheap to test.
WS = rf"\t-\r\x1c-\x20{_SEPARATORS}"
DIGIT = r"\p{Nd}"
WORD = r"a-zA-Z0-9_\p{L}\p{N}"
#: White space within a line.
BLANK = rf"\t\x0b-\r\x1c-\x20{_SEPARATORS}"

HEADING = rf"^(#{{1,6}}[{WS}]+[^{WS}]|{DIGIT}+(\.{DIGIT}+)*[.)][{WS}]+[^{WS}]|[A-Z][A-Z0-9 ,\-:/&']{{3,60}}\z)"
SENTENCE_END = rf"(?<=[.!?])[{WS}]+(?=[A-Z\"'(\[])"
