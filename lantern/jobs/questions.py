"""Benchmark questions over an archive, in seven classes by the kinds of service that an answer needs.

truth names the query (see __spark_entry__) whose result an answer is measured against; questions
over several services have none of their own and are measured by coverage.
"""

from __future__ import annotations

from ..operators.evaluate import CLASSES
from ..plans.documents import ASKED
from .benchmark import Question

REQUIRED = {"1": ("sql",), "2": ("graph",), "3": ("document",), "4a": ("sql", "graph"), "4b": ("sql", "document"), "4c": ("graph", "document"), "5": ("sql", "graph", "document")}

RELATIONAL = {
    "rel_top_users": "Who are the ten users of highest reputation?", "rel_users_filter_date": "Which users of some reputation joined before 2021?", "rel_top_questions": "Which questions score highest?", "rel_top_tags": "Which tags are used most?",
    "rel_tag_ilike": "Which questions of one tag score highest?", "rel_upvoters": "Who gave more than fifty up-votes?", "rel_accepted_scored": "Which questions with an accepted answer score above ten?", "rel_badge_count": "Who holds most badges?",
    "rel_gold_holders": "Who holds a gold badge?", "rel_many_answers": "Which questions have more than four answers?", "rel_monthly_volume": "How many questions were asked in each month of 2022?", "rel_two_metrics": "Who votes up and down a lot?",
    "rel_most_comments": "Which posts are commented on most?", "rel_views_gt": "Which questions were viewed more than a thousand times?", "rel_location_ilike": "Who lives in one country?", "rel_tag_badge_holders": "Which tag badges have most holders?",
    "rel_answer_scores": "How do the answers to question 1 score?", "rel_zero_reputation": "Which users have no reputation yet?", "rel_closed_duplicates": "Which closed questions are duplicates?", "rel_avg_score_per_tag": "Which tags have the best questions on average?",
}
GRAPH = {
    "graph_two_hops": "Which questions are within two links of question 1?", "graph_co_tags_main": "Which tags go along with one tag most often?", "graph_answerers_in_tag": "Who answered questions of one tag?", "graph_duplicates": "Which questions duplicate which?",
    "graph_common_tags": "Which tags go along with both of two tags?", "graph_asked_and_answered": "Who both asked and answered in one tag?", "graph_accepted_other": "Which accepted answers come from someone else?", "graph_co_tags_second": "Which tags go along with another tag?",
    "graph_duplicate_chains": "Which questions end the longest chains of duplicates?", "graph_link_in_degree": "Which questions are linked to most?", "graph_user_degree": "Which users take part most?", "graph_tag_degree": "Which tags go along with most others?",
    "graph_tag_two_hops": "Which tags are within two steps of one tag?", "graph_link_out_degree": "Which questions link to most others?", "graph_distinct_tags": "Who answered in most different tags?", "graph_co_tags_third": "Which tags are next to a third tag?",
    "graph_self_accepted": "How many questions were answered by their askers to their own satisfaction?", "graph_many_questions": "Who asked more than five questions?", "graph_both_tags": "Which questions have both of two tags?", "graph_common_tags_other": "Which tags go along with both of two other tags?",
}
ACROSS = {
    "4a": [
        "How reputed are those who ask in a tag, and which tags go along with it?", "Who holds most badges among those who answer in many tags?", "Are linked questions scored higher than others?", "Which reputed users answer questions that were closed as duplicates?", "How do the scores within a chain of duplicates compare?",
        "Which months brought most questions of a tag and its neighbours?", "Do users with gold badges answer across more tags?", "How often are questions viewed that many others link to?", "Which tags with few questions go along with the most others?", "Who accepted answers of users less reputed than themselves?",
        "How many votes fell on questions two links away from question 1?", "Which askers of low reputation had an answer accepted in a busy tag?", "How do average scores differ between tags that go along?", "Who answers most among users without any badge?", "Which linked questions have no answer yet?",
    ],
    "4b": [
        "What do the best scored questions of a tag say?", "Do longer texts score higher?", "What do users of high reputation say about themselves?", "What do closed questions ask for?", "Which errors are described in the most viewed questions?",
        "What do answers with negative scores say?", "How do questions of this year word what those of last year asked?", "Which versions do accepted answers name most?", "What do comments on the best answers add?", "What do the wikis of the most used tags explain?",
        "How do askers without reputation describe their problem?", "Which texts in other languages score above the mean?", "What do answers given within a day of their question say?", "What do users in one country write about themselves?", "Which questions with most answers are about memory?",
    ],
    "4c": [
        "What do duplicates of one question say that it does not?", "Which texts of the tags next to one tag explain it?", "What do the most linked questions say?", "What do answers to both a question and its duplicate have in common?", "How do two tags' wikis differ where the tags go along?",
        "What does the text at the end of the longest chain say?", "Which texts connect two tags that share no question?", "What do those who answer in two tags write in each?", "Which questions around question 1 mention an error code?", "What do accepted answers of linked questions recommend?",
        "How do the neighbours of one tag describe it?", "What do self-answered questions explain?", "Which texts do users two answers apart share words in?", "What do questions with three tags of one community say?", "Which texts of a community name a version?",
    ],
    "5": [
        "Who are the reputed users active of late, in which tags, and what did they answer?", "Which tags grow, what goes along with them, and what is asked in them?", "Which accepted answers of reputed users are cited in linked questions?", "What do the best answers in the neighbourhood of a busy tag say?", "Which duplicates draw more views than their originals, and what do they say better?",
        "Who answers first in a tag, how are they rated, and what do they advise?", "Which chains of duplicates end in a low score, and what is their text?", "What do badge holders write in tags they are new to?", "Which errors are asked about most in tags that go along?", "How do answers to linked questions differ in score and wording?",
        "Which users connect two communities of tags, how reputed are they, and what do they write?", "What is asked in tags whose scores fall?", "Which self-answered questions are linked to most, and what do they say?", "What do closed questions of the busiest tags have in common?", "Which texts of highly viewed questions name the tags next to theirs?",
    ],
}


def all_questions() -> list[Question]:
    """Every question in the order of the classes, with its id: c<class>_q<number>."""
    out = []
    for label in CLASSES:
        texts = {"1": list(RELATIONAL.values()), "2": list(GRAPH.values()), "3": [f"Which texts are about: {t}?" if t else "Which texts are about nothing?" for _, t in ASKED]}.get(label) or ACROSS[label]
        for n, text in enumerate(texts, 1):
            metric = "ndcg10" if "most" in text and label == "2" else "recall10" if label == "3" else "f1"
            out.append(Question(f"c{label}_q{n:02d}", label, text, REQUIRED[label], metric))
    return out


def truth(question_id: str) -> str | None:
    """The query that holds the right answer, if one does."""
    label, _, n = question_id[1:].partition("_q")
    names = {"1": list(RELATIONAL), "2": list(GRAPH), "3": ["doc_search"] * len(ASKED)}.get(label)
    return names[int(n) - 1] if names else None
