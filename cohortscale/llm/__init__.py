"""Operators over report documents and published pages at training-corpus scale.

Nothing outside this folder imports it. The records are those of the rest of the library:
documents (doc_id, text), as ``operators.reconcile`` looks statements up in, statements
(statement_id, statement), pages (page_id, url, html) of the published site, and review
verdicts (doc_id, accepted) on documents.
"""
