"""A two-video fixture: contexts, comments and the outcomes expected of them."""

CONTEXTS = [
    (
        video, "Steak cooking tutorial", summary, ["creator"], ["steak", "pan"], ["kitchen"],
        [("0:00", "0:20", "Creator introduces the steak prep process"),
         ("0:20", "0:45", "Creator explains room temperature rest and pan prep")],
        [moment], [moment], transcript, shown, ["Comment below"],
    )
    for video, summary, moment, transcript, shown in [
        (
            "v1", "Creator explains how to cook steak and says to leave it at room temperature for an hour.",
            ("0:42", "Creator says steak can sit at room temperature for an hour"),
            "Let your steak sit at room temperature for at least an hour.\nDo not move it once it hits the pan.",
            ["Room temp 1 hour", "Do not move steak"],
        ),
        (
            "v2", "Another creator gives similar steak advice and viewers debate the safety of leaving meat out.",
            ("0:30", "Creator repeats the one hour room temperature advice"),
            "I always let steak sit out for an hour before cooking.\nThat is the only way I do it.",
            ["Let steak rest 1 hour", "Best steak method"],
        ),
    ]
]

COMMENT_SCHEMA = (
    "video_id STRING, comment_id STRING, parent_comment_id STRING, depth INT, author_id STRING, text STRING, "
    "likes BIGINT, reply_count BIGINT, shares BIGINT, views BIGINT"
)
COMMENTS = [
    ("v1", "c1", None, 0, "u1", "that part is unsafe", 12, 1, 0, 0),
    ("v1", "c1r1", "c1", 1, "u2", "same", 3, 0, 0, 0),
    ("v1", "c2", None, 0, "u3", "do not move it once it hits the pan is actually useful", 9, 0, 0, 0),
    ("v1", "c3", None, 0, "u4", "lol", 1, 0, 0, 0),
    ("v1", "c4", None, 0, "u7", "Very informative. I won't remember any of them.", 5, 0, 0, 0),
    ("v1", "c5", None, 0, "u8", "Great tips keep it up", 4, 0, 0, 0),
    ("v2", "d1", None, 0, "u5", "leaving steak out that long is risky", 15, 0, 0, 0),
    ("v2", "d2", None, 0, "u6", "what temp should the pan be?", 4, 0, 0, 0),
]

V1_ANCHORS = """v1_global_video
v1_moment_0_42_creator_says_steak_can_sit_at_room_temperature_for_an_hour
v1_timeline_0_00_creator_introduces_the_steak_prep_process
v1_timeline_0_20_creator_explains_room_temperature_rest_and_pan_prep
v1_person_creator
v1_object_steak
v1_object_pan
v1_location_kitchen
v1_quote_0_let_your_steak_sit_at_room_temperature_for_at_least_an_hour
v1_quote_1_do_not_move_it_once_it_hits_the_pan
v1_visual_0_room_temp_1_hour
v1_visual_1_do_not_move_steak""".split()

GROUNDING = [
    ("c1", ["moment_0_42", "room_temperature_for_an_hour"]),
    ("c1r1", ["moment_0_42", "room_temperature_for_an_hour"]),
    ("c2", ["quote_1", "do_not_move_it_once_it_hits_the_pan"]),
    ("d1", ["moment_0_30", "room_temperature_advice"]),
    ("d2", ["object_pan", "pan"]),
    ("c5", ["global_video"]),
]
UNIT_LABELS = [
    ("c1_unit_1", "room_temp_safety_negative"), ("c1r1_unit_1", "room_temp_safety_negative"),
    ("c2_unit_1", "pan_handling_positive"), ("c3_unit_1", "reaction_noise"), ("c4_unit_1", "retention_negative"),
    ("c5_unit_1", "generic_video_praise"), ("d1_unit_1", "room_temp_safety_negative"),
    ("d2_unit_1", "pan_temperature_question"),
]
ENGAGEMENT = {"c1": 3.605, "c1r1": 1.386, "c2": 2.303, "c4": 1.792, "c5": 1.609, "d1": 2.773, "d2": 1.609}
STANCES = {
    "c1_unit_1": "negative", "c1r1_unit_1": "negative", "c2_unit_1": "positive", "c4_unit_1": "negative",
    "c5_unit_1": "positive", "d1_unit_1": "negative", "d2_unit_1": "question",
}
INTENTS = {
    "c1_unit_1": "feedback", "c1r1_unit_1": "agreement", "c2_unit_1": "disagreement", "c4_unit_1": "feedback",
    "c5_unit_1": "feedback", "d1_unit_1": "feedback", "d2_unit_1": "information_request",
}
# cluster id -> importance
CLUSTERS = {
    "v1_controversy_creator_says_steak_can_sit_a_opinion_negative_2": 0.81,
    "v1_spoken_quote_do_not_move_it_once_it_hits_opinion_positive_1": 0.291,
    "v1_global_video_steak_cooking_tutorial_opinion_positive_1": 0.054,
    "v1_video_video_wide_discussion_opinion_negative_1": 0.011,
    "v2_controversy_creator_repeats_the_one_hour_opinion_negative_1": 0.85,
    "v2_entity_pan_question_question_1": 0.7,
}
# unit -> recorded grounding and density, for the importance arithmetic alone
UNIT_VALUES = {
    "c1_unit_1": (0.4, 0.35), "c1r1_unit_1": (0.22, 0.75), "c2_unit_1": (0.98, 0.95), "c4_unit_1": (0.2, 0.3),
    "c5_unit_1": (0.28, 0.55), "d1_unit_1": (0.4, 0.95), "d2_unit_1": (0.5, 0.45),
}
