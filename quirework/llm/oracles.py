"""SQL of the operators 11 and 12."""

ORACLES = {
    # The pages of the tables have one article element each, of a heading and paragraphs, and these references.
    "op11_html_extraction": r"""
        WITH parts AS (
            SELECT page_id, url, string_split_regex(regexp_extract(html, '<article>(.*?)</article>', 1, 's'), '</?(p|h1)>') AS raw
            FROM pages
        ), told AS (
            SELECT page_id, url, list_transform(raw, lambda x : trim(regexp_replace(
                replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))) AS blocks
            FROM parts
        ), joined AS (
            SELECT page_id, url, array_to_string(list_filter(blocks, lambda x : x <> ''), chr(10)) AS text FROM told
        )
        SELECT page_id, url, text, length(text)::BIGINT AS n_chars, true AS marked FROM joined
    """,
    "op12_merkle_manifest": r"""
        WITH RECURSIVE told AS (
            SELECT doc_id, source, text, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-')
                       || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
                       || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
                   list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda d : ascii(d)::BIGINT), lambda c, b :
                       list_reduce(range(8), lambda x, k : xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), 4294967295::BIGINT) AS crc
            FROM documents
        ), leaves AS (
            SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(
                       CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), '')
                       ELSE strlen(text) || ':' || text END, '-')) AS changed
            FROM told
        ), placed AS (
            SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
                   row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx
            FROM leaves
        ), nodes AS (
            SELECT tree, 0 AS level, idx, leaf AS digest FROM placed
            UNION ALL
            SELECT tree, any_value(level) + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx))
            FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM nodes) WHERE n > 1 GROUP BY tree, idx // 3
        ), subroots AS (
            SELECT tree, arg_max(digest, level) AS subroot FROM nodes GROUP BY tree
        ), upper AS (
            SELECT 0 AS level, tree AS idx, subroot AS digest FROM subroots
            UNION ALL
            SELECT any_value(level) + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx))
            FROM (SELECT *, count(*) OVER () AS n FROM upper) WHERE n > 1 GROUP BY idx // 3
        ), runs AS (
            SELECT tree, level, idx // 3 AS run, list(digest ORDER BY idx) AS members
            FROM (SELECT *, count(*) OVER (PARTITION BY tree, level) AS n FROM nodes) WHERE n > 1 GROUP BY tree, level, idx // 3
        ), upper_runs AS (
            SELECT level, idx // 3 AS run, list(digest ORDER BY idx) AS members
            FROM (SELECT *, count(*) OVER (PARTITION BY level) AS n FROM upper) WHERE n > 1 GROUP BY level, idx // 3
        ), climbed AS (
            SELECT tree, idx AS leaf_idx, 0 AS level, idx AS spot, changed AS folded, '' AS beside FROM placed
            UNION ALL
            SELECT c.tree, leaf_idx, c.level + 1, spot // 3,
                   sha256(array_to_string(members[1 : spot % 3], '') || folded || array_to_string(members[spot % 3 + 2 :], '')),
                   beside || array_to_string(members[1 : spot % 3], '') || array_to_string(members[spot % 3 + 2 :], '')
            FROM climbed c JOIN runs r ON c.tree = r.tree AND c.level = r.level AND spot // 3 = run
        ), below AS (
            SELECT tree, leaf_idx, arg_max(folded, level) AS folded, arg_max(beside, level) AS beside FROM climbed GROUP BY tree, leaf_idx
        ), risen AS (
            SELECT tree, leaf_idx, 0 AS level, tree AS spot, folded, beside FROM below
            UNION ALL
            SELECT c.tree, leaf_idx, c.level + 1, spot // 3,
                   sha256(array_to_string(members[1 : spot % 3], '') || folded || array_to_string(members[spot % 3 + 2 :], '')),
                   beside || array_to_string(members[1 : spot % 3], '') || array_to_string(members[spot % 3 + 2 :], '')
            FROM risen c JOIN upper_runs r ON c.level = r.level AND spot // 3 = run
        ), ended AS (
            SELECT tree, leaf_idx, arg_max(folded, level) AS folded, arg_max(beside, level) AS beside FROM risen GROUP BY tree, leaf_idx
        )
        SELECT doc_id, leaf, subroot, root, sha256(beside) AS proof_sha256, folded AS folded_root, source, idx,
               (length(beside) // 64)::INT AS n_siblings, folded = root AS verified
        FROM placed JOIN subroots USING (tree) JOIN ended ON placed.tree = ended.tree AND idx = leaf_idx,
             (SELECT arg_max(digest, level) AS root FROM upper)
    """,
}
